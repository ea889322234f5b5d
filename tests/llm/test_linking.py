"""Pairs of components that share many keys come out of the join once, and none is lost."""

import random

from pyspark.sql import functions as F

from chainevents.llm import linking


def met(spark, keys):
    """Pairs of nodes that share a key, as the join gives them; each node is a component of its own."""
    given = spark.createDataFrame([(s, k, k) for k, own in keys.items() for s in own], "sig long, node long, root long")
    return sorted(map(tuple, linking._apart_pairs(given.join(linking._firsts(given), "node"), F.lit(True)).collect()))


def wanted(keys):
    return sorted((u, v) for u in keys for v in keys if u < v and set(keys[u]) & set(keys[v]))


def test_a_pair_with_many_common_keys_comes_once(spark):
    chance = random.Random(5)
    keys = {k: sorted({*chance.sample(range(-20, 20), 24), 100 + k}) for k in range(30)}
    assert met(spark, keys) == wanted(keys) and len(wanted(keys)) == 435


def test_pairs_whose_common_keys_are_not_among_the_first_ones_stay(spark):
    many = linking.FIRSTS
    keys = {k: [*range(k * 1000 - 5000, k * 1000 - 5000 + many + 3), 10_000, 10_001] for k in range(4)} | {9: [10_001, 77_777]}
    assert set(met(spark, keys)) == set(wanted(keys)) and len(wanted(keys)) == 10
