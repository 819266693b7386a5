"""What a Python worker holds depends neither on the rows of a batch nor on the tasks before."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from grainmill.llm import bpe, minhash, mixing, worker
from grainmill.llm.words import GROUP_BYTES

TEXTS = [None if k == 5 else " ".join(f"w{k}x{j}" for j in range(40_000 if k == 7 else 150)) for k in range(4000)]


class Plan:
    """Stands for a DataFrame and keeps the function that is mapped over its batches."""

    def select(self, *_):
        return self

    selectExpr = select

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def mixed_batch():
    sizes = [len(t.split()) if t else 0 for t in TEXTS]
    draws = [[{"shard": 0, "at": k, "pass": 0, "from_word": 0, "to_word": n}, {"shard": 0, "at": k, "pass": 1, "from_word": 3, "to_word": 9}] if n else [] for k, n in enumerate(sizes)]
    n = len(TEXTS)
    return pa.record_batch({"doc_id": pa.array(range(n)), "text": TEXTS, "lang": ["en"] * n, "source": ["a"] * n, "n_chars": pa.array([len(t or "") for t in TEXTS]), "__size": pa.array(sizes), "__draws": draws})


def test_the_mix_is_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(mixing, "_with_draws", lambda docs, **_: docs)
    batch = mixed_batch()
    assert batch.column("text").nbytes > 4 * GROUP_BYTES
    found = list(mixing.mix_documents(Plan()).run(iter([batch])))
    assert max(b.nbytes for b in found) < 2 * GROUP_BYTES and len(found) > 4
    rows = [(d["doc_id"], d["text"]) for b in found for d in b.to_pylist()]
    assert rows == [x for k, t in enumerate(TEXTS) if t for x in ((k, t), (k, " ".join(t.split()[3:9])))]


def test_encoding_takes_a_batch_in_parts():
    plan = bpe.encode_digests(Plan(), public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.record_batch({"doc_id": pa.array(range(len(TEXTS))), "text": [None if t is None else t[:2000] for t in TEXTS]})
    found = list(plan.run(iter([batch])))
    assert len(found) > 1 and [i for b in found for i in b.column("doc_id").to_pylist()] == list(range(len(TEXTS)))
    assert found[0].column("n_tokens")[5].as_py() == 0


def test_excerpts_of_a_long_text():
    words = [f"w{j}" for j in range(200_000)]
    text = " \t".join(words)
    tracemalloc.start()
    found = mixing._excerpt(text, [(7, 8), (199_998, 200_000), (8, 11), (50, 52)], len(words))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == "\n".join(" \t".join(words[a:b]) for a, b in ((7, 11), (50, 52), (199_998, 200_000)))
    assert peak < len(text)


def test_excerpts_like_cut_words():
    rng = np.random.default_rng(3)
    for _ in range(200):
        words = [f"w{j}" for j in range(int(rng.integers(2, 30)))]
        ends = np.unique(rng.integers(0, len(words) + 1, 2 * int(rng.integers(1, 5)))).tolist()
        ranges = [(a, b) for a, b in zip(ends[::2], ends[1::2], strict=False)]
        assert mixing._excerpt("  ".join(words), ranges, len(words)) == "\n".join("  ".join(words[a:b]) for a, b in ranges)


@pytest.mark.parametrize("failing", [False, True])
def test_free_memory_goes_back_after_a_partition(monkeypatch, failing):
    given = []
    monkeypatch.setattr(worker, "give_back", lambda: given.append(1))
    texts = pa.record_batch({"row": pa.array([0, 1]), "text": ["one two", "three"]})
    if failing:
        with pytest.raises(Exception):  # noqa: B017
            list(minhash._sketch(iter([texts.select(["row"])])))
    else:
        assert sum(b.num_rows for b in minhash._sketch(iter([texts]))) == 2
    assert given == [1]


def test_free_memory_goes_back_after_a_large_group(monkeypatch):
    given = []
    monkeypatch.setattr(worker, "give_back", lambda: given.append(1))
    for times, want in ((1, []), (400, [1])):
        n = 2
        table = pa.table({"side": pa.array([0] * n, pa.int32()), "node": pa.array(range(n)), "root": pa.array(range(n)), "text": [" ".join(f"a{j}" for j in range(1000 * times)) + x for x in ("", " b")]})
        assert minhash._settle_block(75)(tuple(pa.scalar(0) for _ in range(3)), table).num_rows <= 1
        assert given == want


def test_give_back():
    worker.give_back()
