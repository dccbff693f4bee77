"""Groups that are cut: a text has its rarest shingles once, whatever number of groups it is in."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from siltstone.llm import near_copies
from test_near_copies import brute_set, unlike


def test_rows_do_not_grow_with_the_groups(spark):
    texts = unlike(random.Random(4), 30)
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    rooted = df.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))).alias("h"), F.col("key").alias("root"))
    got = [(r.h, r.key) for r in near_copies._cut(rooted.select("h", "key", "root"), df).collect()]
    sets = [brute_set(t) for t in texts]
    rows = Counter(key for _, key in got)
    assert len(got) == len(set(got)) and all(n <= len(sets[key]) // 5 + 1 for key, n in rows.items())
    met = defaultdict(set)
    for h, key in got:
        met[key].add(h)
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    assert len(alike) == 3 and all(met[i] & met[j] for i, j in alike)
