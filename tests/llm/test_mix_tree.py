"""The splitting tree: its law, and that it decides what is drawn."""

import collections
import math

import numpy as np
import pytest

from grainmill.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(("good", "bad", "draws"), [(7, 13, 5), (13, 7, 12), (1, 40, 20), (60, 50, 55), (300, 5000, 900), (3, 3, 3)])
def test_hypergeometric_law(good, bad, draws):
    rng, n = np.random.default_rng(5), 20_000
    found = collections.Counter(mixing.hypergeometric(rng, good, bad, draws) for _ in range(n))
    want = {k: n * math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    assert set(found) <= set(want)
    likely = [k for k in want if want[k] >= 5]
    chi = sum((found[k] - want[k]) ** 2 / want[k] for k in likely)
    assert chi < len(likely) + 5 * math.sqrt(2 * len(likely)) + 5


@pytest.mark.parametrize("scale", [10**8, 10**9, 10**10, 10**13])
def test_hypergeometric_of_large_counts(scale):
    """No switch of method at any size: mean and variance are those of the law."""
    rng, good, bad, draws, n = np.random.default_rng(6), 3 * scale, 5 * scale, 2 * scale, 4000
    x = np.array([mixing.hypergeometric(rng, good, bad, draws) - 3 * draws // 8 for _ in range(n)], float)
    total = good + bad
    var = draws * (good / total) * (bad / total) * ((total - draws) / (total - 1))
    assert abs(x.mean()) < 4 * math.sqrt(var / n) + 1 and abs(x.var() / var - 1) < 4 * math.sqrt(2 / n)


def test_log_ratio():
    for n, d in ((5, 3), (2000, -700), (2000, 900), (1100, -1050), (5000, 1)):
        assert mixing._log_ratio(n, d) == pytest.approx(math.log(math.factorial(n + d)) - math.log(math.factorial(n)), abs=1e-8)


def brute(sizes, shards, split, share_target, key, block):
    """Words taken of each document of one source by walking over its blocks one at a time."""
    total = sum(sizes)
    passes, part = divmod(min(round(share_target), 2 * total), total)
    full, blocks = total // block, -(-total // block)
    owner = [d for d, s in enumerate(sizes) for _ in range(s)]
    taken = collections.Counter()
    for p in range(passes + (part > 0)):
        quota = blocks if p < passes else -(-part // block)
        line = quota if p < passes else full if quota <= full else blocks
        order = {int(a): b for b, a in enumerate(mixing.permuted(np.arange(full), full, key + p))} | {full: full}
        done = 0
        for mine in (row[p] for row in split):
            lo = done * line // quota
            for nth in range(mine):
                b = order[lo + nth]
                words = owner[b * block : b * block + block]
                if p == passes:
                    words = words[: part - (done + nth) * block]
                taken.update(words)
            done += mine
    return [taken[d] for d in range(len(sizes))]


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_taken_follows_the_shards(spark, shards):
    rng = np.random.default_rng(1)
    rows = [(k, "w " * int(n), "en", s, 0) for k, (n, s) in enumerate(zip(rng.integers(0, 90, 300), np.resize(["a", "b", "b", "c", None], 300).tolist(), strict=True))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r for r in mixing.draws(docs, shards=shards, block=16).collect()}
    plan = sorted({(rows[i][3] is None, rows[i][3] or "", r["source_size"], r["target"]) for i, r in found.items()})
    sources = [mixing._Source(None if none else name, size, target, 7, 16) for none, name, size, target in plan]
    split, at = mixing.split_quotas([q for s in sources for q in s.quotas], shards, 7), 0
    for (none, name, _, target), s in zip(plan, sources, strict=True):
        ids = [k for k, r in enumerate(rows) if r[3] == (None if none else name)]
        want = brute([found[i]["size"] for i in ids], shards, [row[at : at + len(s.quotas)] for row in split], target, s.key, 16)
        at += len(s.quotas)
        assert [found[i]["taken"] for i in ids] == want and sum(want) == round(target)
        assert all(found[i]["taken"] <= 2 * found[i]["size"] for i in ids)
    for r in found.values():
        assert sum(x["to_word"] - x["from_word"] for x in r["draws"]) == r["taken"] and r["n_shards"] == len({x["shard"] for x in r["draws"]})


def test_another_split_draws_other_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * 50, "en", "abc"[k % 3], 0) for k in range(300)], SCHEMA)
    take = lambda **o: {r["doc_id"]: r["taken"] for r in mixing.draws(docs, block=16, **o).collect()}
    few, many = take(shards=2), take(shards=16)
    assert sum(few.values()) == sum(many.values()) and few != many
    text = lambda **o: sorted((r["doc_id"], r["text"]) for r in mixing.mix_documents(docs, block=16, **o).collect())
    assert text(shards=2) != text(shards=16)
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [list(quotas), *[[0] * len(quotas)] * (shards - 1)])
    assert take(shards=2) != few
