"""Operators against brute force, and their defined results in odd cases."""

import base64
import collections
import fractions
import hashlib
import io
import math
import re
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer as Reference

from grainmill.llm import entry, mixing, pii, quality, topk, warc
from grainmill.llm.bpe import Tokenizer, decode, encode, encode_digests
from grainmill.llm.components import components
from grainmill.llm.exactdedup import exact_duplicates, without_duplicates
from grainmill.llm.minhash import near_duplicates
from grainmill.llm.tokencount import scan_token_files, token_counts, write_token_files
from grainmill.session import shared_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, size string, sha string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0 if t is None else len(t), 7, "x", "y", "z") for i, t, s in rows], DOCS)


def test_exact_dedup(spark, odd):
    found = exact_duplicates(docs_of(spark, odd), 3, 2).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in odd:
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    assert len(found) == len(odd)
    for sha, ids in groups.items():
        rows = [r for r in found if r["text_sha256"] == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(ids)
        assert {r["keep_id"] for r in rows} == {least} and {r["group_size"] for r in rows} == {len(ids)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [least]


def test_without_duplicates(spark, odd):
    docs = docs_of(spark, odd)
    found = without_duplicates(docs)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    want = {}
    for i, t, _ in odd:
        key = norm(t)
        want[key] = i if want.get(key) is None else want[key] if i is None else min(i, want[key])
    assert found.columns == docs.columns
    got = [(norm(r["text"]), r["doc_id"]) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert without_duplicates(docs_of(spark, [(None, "p", "a"), (None, "p", "b"), (None, "q", "a")])).count() == 2


def brute_near(rows, percent=75):
    sets = {}
    for k, (_, t, _) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return collections.Counter((i, len(sets[k]), min(least[find(k)], default=None)) for k, (i, _, _) in enumerate(rows))


def test_near_duplicates(spark, odd):
    found = near_duplicates(docs_of(spark, odd)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_near(odd)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_a_crowded_band(spark):
    """Many texts near the threshold: components must not depend on which pair is tried first."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            words[at] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(words), "a"))
    found = near_duplicates(docs_of(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_near(rows)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["Hello  World's 123 it'll!!", "<|endoftext|>a<|startoftext|> b", "ÉÈ ΣΑΣ İ x́ 中文   \x1c y", "a" * 3000, "thethe" * 200, "😀😀 ＡＢ"]


def test_bpe_equals_the_library(spark):
    ref, tok = Reference.from_file(entry.TOKENIZER), Tokenizer(open(entry.TOKENIZER, "rb").read())
    rng = np.random.default_rng(2)
    letters = list("abcdefghiklmnoprstuvwyz'., 0123!éñß\t\n")
    for text in [*TEXTS, *("".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(400))]:
        want = ref.encode(text, add_special_tokens=False).ids
        assert tok.encode(text) == want
        assert tok.decode(want) == ref.decode(want, skip_special_tokens=False)


def test_bpe_of_every_code_point():
    """Between letters, after a combining mark's base, and as capitals: as the library has it."""
    ref, tok = Reference.from_file(entry.TOKENIZER), Tokenizer(open(entry.TOKENIZER, "rb").read())
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in chars] + ["".join(chars[k : k + 64]) for k in range(0, len(chars), 64)]
    assert [x for x, want in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True) if tok.encode(x) != want.ids] == []


def test_bpe_of_unbroken_text():
    """A megabyte without a gap, and more states than the machine's table holds."""
    ref, tok = Reference.from_file(entry.TOKENIZER), Tokenizer(open(entry.TOKENIZER, "rb").read())
    rng = np.random.default_rng(7)
    tok.machine.budget = 3 << 20
    tok.machine._forget()
    for text in ("a" * 1_000_000, "the" * 300_000, "".join(rng.choice(list("abcdefghijklmnop"), 150_000)), "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 40_000)))):
        assert tok.encode(text) == ref.encode(text, add_special_tokens=False).ids
        assert tok.machine.bytes < 4 << 20


def test_automaton_accepts_correct_tokenisations():
    """A pair of tokens follows an arc just where encoding their bytes gives back the pair."""
    ref, tok = Reference.from_file(entry.TOKENIZER), Tokenizer(open(entry.TOKENIZER, "rb").read())
    a, rng = tok.machine.automaton, np.random.default_rng(3)
    plain = [i for i in a.labels if not a.ends[i] and a.spelt[i].isalpha() and a.spelt[i].islower()]
    last = [i for i in a.labels if a.ends[i] and a.spelt[i].isalpha() and a.spelt[i].islower()]
    for x, y in zip(rng.choice(plain, 4000).tolist(), rng.choice(last, 4000).tolist(), strict=True):
        want = ref.encode((a.spelt[x] + a.spelt[y]).decode(), add_special_tokens=False).ids == [x, y]
        assert a.arc(a.target[x], y) == want


def test_bpe_query(spark, odd):
    ref = Reference.from_file(entry.TOKENIZER)
    rows = [*odd, *((2000 + i, t, "a") for i, t in enumerate(TEXTS))]
    found = encode_digests(docs_of(spark, rows), entry.TOKENIZER).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in found) == want


def test_bpe_tables(spark):
    docs = docs_of(spark, [(1, "Hello you", "a"), (2, None, "a")])
    assert {r["doc_id"]: r["text"] for r in decode(encode(docs, entry.TOKENIZER), entry.TOKENIZER).collect()} == {1: "hello</w> you</w>", 2: ""}


@pytest.mark.parametrize("block", [6, 64, 1 << 20])
def test_token_files(spark, odd, block):
    ref = Reference.from_file(entry.TOKENIZER)
    ref.encode_special_tokens = True
    rows = [(i, t[:5000] if t else t, s) for i, t, s in odd[: 12 if block == 6 else None]]
    docs, at = docs_of(spark, rows), shared_path(spark, "test-tokens")
    owners = write_token_files(docs, entry.TOKENIZER, at)
    counts = scan_token_files(spark, at, owners.select("file").distinct(), block_bytes=block)
    found = owners.join(counts, ["file", "ordinal"]).collect()
    want = collections.Counter((i, len(ref.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in found) == want


def test_token_counts_of_special_strings(spark):
    assert [r["n_tokens"] > 1 for r in token_counts(docs_of(spark, [(1, "<|endoftext|>", "a")]), entry.TOKENIZER).collect()] == [True]


def test_mix(spark, odd):
    rows = [r for r in odd if r[0] != 9] + [(9, " ".join(["w"] * 1000), "b"), (10, " ".join(["w"] * 70), "a")]
    docs = docs_of(spark, rows)
    found = mixing.draws(docs, shards=4).collect()
    assert len(found) == len(rows)
    by = collections.defaultdict(list)
    source = {i: s for i, _, s in rows if i is not None}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            by[source[r["doc_id"]]].append(r)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, total = {}, 1.5 * sum(sizes.values())
    while True:
        left = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in names if x not in target) for s in names if s not in target}
        over = [s for s in left if left[s] > 2 * sizes[s]]
        if not over:
            target |= left
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    for s, got in by.items():
        assert got[0]["source_size"] == sizes[s] and got[0]["target"] == pytest.approx(target[s])
        if s not in (None, "c"):
            assert sum(r["taken"] for r in got) == pytest.approx(target[s], abs=1)
    again = mixing.draws(docs.repartition(5), shards=4).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"])
    assert [tuple(r)[1:6] for r in sorted(found, key=key)] == [tuple(r)[1:6] for r in sorted(again, key=key)]
    words = lambda t: len(WORD.findall(t))
    taken = sum(r["taken"] for r in found)
    assert sum(words(r["text"]) for r in mixing.mix_documents(docs).collect()) == taken
    assert sum(words(r["text"]) for r in mixing.mix_blocks(docs, shards=4).collect()) == taken


def test_split_quotas_and_permutation():
    quotas = [1000, 7, 0, 3_000_000_000, 10**14]
    parts = mixing.split_quotas(quotas, 7, 3)
    assert [sum(c) for c in zip(*parts, strict=True)] == quotas and min(map(min, parts)) >= 0
    assert max(map(sum, parts)) - min(map(sum, parts)) <= 3
    for n in (1, 2, 5, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


VECTORS = "vec_id long, embedding array<float>, label int, q string, score long"


@pytest.mark.parametrize("block", [topk.QUERY_BLOCK, 3])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(400)]
    rows += [(3000 + i, (rng.normal(size=8) * 1e5).round(2).tolist()) for i in range(60)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")] * 8), (2200, []), (2250, rows[7][1][:3]), (None, rows[1][1]), (50, rows[50][1]), (50, rows[51][1]), (7, rows[9][1])]
    check_top_k(spark, rows)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0], 0, "x", 1), (1, [2.0], 0, "x", 1)], VECTORS)).collect()] == [(0, 1, 1, 256 * 512)]


def check_top_k(spark, rows, found=None):
    got = topk.top_k(spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS), found=found).collect()
    whole = lambda x: math.floor(256 * fractions.Fraction(float(np.float32(x))))
    q = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.Counter()
    for n, (a, mine) in enumerate(q):
        if a is not None and a % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(mine, v, strict=False)), b is None, b or 0) for m, (b, v) in enumerate(q) if m != n)[:5]
            want.update((a, k + 1, None if none else b, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, none, b) in enumerate(best))
    assert collections.Counter(map(tuple, got)) == want


def test_top_k_of_any_size(spark):
    """Components for which neither doubles nor 64 bits hold the scores."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 38)]) for i in range(200)]
    check_top_k(spark, rows + [(300, [3e5, 3e5]), (350, [-3.4e38, 3.4e38]), (400, [2.0**26] * 4), (450, [1e-30, -1e-30])])


def test_top_k_passes_over_rows(spark):
    """Of clustered rows few scores are computed."""
    rng, found = np.random.default_rng(3), []
    centres = rng.normal(size=(40, 16)) * 20
    check_top_k(spark, [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(3000)], found)
    assert sum(c for c, _ in found) < 0.2 * sum(n for _, n in found)


def test_pseudonyms(spark):
    key = b"k"
    text = "Card 4111 1111 1111 1111, again 4111111111111111; mail jo.doe7@mail.example.com on 2024-02-29 or 31.12.1999. IP 10.0.0.255 call +1 (974) 555-3436, ssn 123-45-6789, GB82 WEST 1234 5698 7654 32."
    new, counts = pii.pseudonymise(text, key)
    assert counts == {"card": 2, "mail": 1, "date": 2, "ip": 1, "phone": 1, "ssn": 1, "iban": 1}
    a, b = re.search(r"Card ([\d ]{19}), again (\d{16})", new).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and pii._luhn(b) % 10 == 0
    again, more = pii.pseudonymise(new, key)
    assert more == counts and again != new
    for clean in ("4111111111111112 and 999.1.1.1 and 2023-02-30", "no numbers here", "", "1.2.3.4.5 v1.2.3"):
        assert pii.pseudonymise(clean, key) == (clean, {})
    card, phone = pii.pseudonymise("4111111111111111", key)[0], pii.pseudonymise("555-123-4567", key)[0]
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    for form, written, kinds in (
        ("{c} {c}", "{c} {c}", {"card": 2}), ("12 {s}", "12 {s}", {"card": 1}), ("9998 {s} 12", "9998 {s} 12", {"card": 1}), ("{p} {s}-7", "{p} {s}-7", {"card": 1, "phone": 1}),
        ("{p} {p}", "{p} {p}", {"phone": 2}), ("\u00e9{c}\u5b57", "\u00e9{c}\u5b57", {"card": 1}), ("4111 1111 1111 1112 {p}", "4111 1111 1111 1112 {p}", {"phone": 1}), ("{c} 10.2.3.4.5", "{c} 10.2.3.4.5", {"card": 1}),
    ):
        given = form.format(c="4111111111111111", s="4111 1111 1111 1111", p="555-123-4567")
        assert pii.pseudonymise(given, key) == (written.format(c=card, s=spaced, p=phone), kinds), given
    for long in ("a%" * 200_000, "1 2 " * 100_000, "4111 " * 40_000, "a." * 200_000, "x@" + "a-" * 200_000, "7" * 200_000):
        assert pii.pseudonymise(long, key)[1].keys() <= {"card"}
    assert sorted(pii.permute(i, 1000, key, "t") for i in range(1000)) == list(range(1000))
    for a, b in (("+1 (974) 555-3436", "+19745553436"), ("+44 20 7946 0958", "+442079460958"), ("+49 301 234-5678", "+493012345678")):
        x, y = (pii.pseudonymise(t, key)[0] for t in (a, b))
        code = len(a.split()[0])
        assert re.sub(r"[^\d+]", "", x) == y != b and x[:code] == a[:code]
    lower = pii.pseudonymise("gb82 west 1234 5698 7654 32 and more", key)
    upper = pii.pseudonymise("GB82WEST12345698765432", key)
    assert lower[0] == " ".join(upper[0].lower()[i : i + 4] for i in range(0, 22, 4)) + " and more" and lower[1] == upper[1] == {"iban": 1}
    spaced, dashed = pii.pseudonymise("ssn 123 45 6789.", key), pii.pseudonymise("ssn 123-45-6789.", key)
    assert spaced[0].replace(" ", "-") == dashed[0].replace(" ", "-") and spaced[1] == dashed[1] == {"ssn": 1}
    with pytest.raises(ValueError):
        pii.pseudonyms(docs_of(spark, []), b"")
    found = pii.pseudonyms(docs_of(spark, [(1, text, "a"), (2, None, "a"), (3, "", None), (3, "", None), (None, "x", "a")]), key).collect()
    assert {(r["doc_id"], r["text"], r["n_replaced"]) for r in found} == {(1, new, 9), (2, None, 0), (3, "", 0), (None, "x", 0)} and len(found) == 5


def test_quality(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet")
    labels = {r["doc_id"]: r["quality"] for r in read("labels").collect()}
    found = quality.quality_scores(read("documents"), read("labels")).collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.9
    odd = quality.quality_scores(docs_of(spark, [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "x" * 700_000, "a")]), read("labels")).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1


def _plain_forward(w, text):
    """The network on one text, a window at a time."""
    pooled, weight, hop = [], [], quality.CHUNK - quality.OVERLAP
    starts = list(range(0, max(1, len(text) - quality.OVERLAP), hop))
    for k, start in enumerate(starts):
        codes = [1 + b for b in text[start : start + quality.CHUNK]]
        codes += [0] * (quality.CHUNK - len(codes))
        best = [max(sum(w["embed"][codes[at + j], d] * w["filter"][j * quality.DIMS + d, f] for j in range(quality.WIDTH) for d in range(quality.DIMS)) for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)) for f in range(quality.FILTERS)]
        pooled.append([math.tanh(x + b) for x, b in zip(best, w["bias"], strict=True)])
        weight.append(starts[k + 1] - start if k + 1 < len(starts) else max(len(text), start + 1) - start)
    mean = [sum(p[f] * v for p, v in zip(pooled, weight, strict=True)) / sum(weight) for f in range(quality.FILTERS)]
    most = [max(p[f] for p in pooled) for f in range(quality.FILTERS)]
    return sum(x * u for x, u in zip(mean + most, w["unit"], strict=True)) + w["base"][0]


def test_network_by_hand():
    """Scores by plain loops, and gradients by differences."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    net = quality.Network(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    net.w["bias"] += rng.normal(size=quality.FILTERS) * 0.1
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 300, 700)]
    want = [1 / (1 + math.exp(-_plain_forward(net.w, t))) for t in texts]
    assert quality.score_texts(net, pa.array([t.decode() for t in texts])) == pytest.approx(want, abs=1e-5)
    y = np.array([1, 0, 1, 0], np.float32)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    starts = [quality.chunk_starts(len(t)) for t in raw]
    chunks = np.concatenate([quality.chunks_of(t, s) for t, s in zip(raw, starts, strict=True)])
    of = np.repeat(np.arange(4), list(map(len, starts)))
    grad = net.gradients(chunks, of, np.concatenate([quality._weights(len(t), s) for t, s in zip(raw, starts, strict=True)]), y)

    def loss(w):
        z = np.array([_plain_forward(w, t) for t in texts])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for name, at in (("unit", (3,)), ("unit", (quality.FILTERS + 5,)), ("base", (0,)), ("bias", (2,)), ("filter", (7, 3)), ("embed", (1 + 100, 2))):
        values = []
        for e in (1e-3, -1e-3):
            w = {k: v.copy() for k, v in net.w.items()}
            w[name][at] += e
            values.append(loss(w))
        assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, abs=2e-4, rel=0.02), (name, at)


def test_training_takes_whole_texts(spark):
    """What marks a text may stand anywhere in a long one."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(240):
        words = rng.choice(["lorem", "ipsum", "dolor", "sit"], 1500).tolist()
        if k % 2:
            words[int(rng.integers(0, 1500))] = "XQZJK#XQZJK#XQZJK"
        rows.append((k, " ".join(words), "a"))
        labels.append((k, k % 2, 0))
    texts, y = quality.training_rows(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality", 500)
    assert len(texts) == len(y) < 240 and all(len(t) == len(rows[0][1].encode()) or len(t) > 5000 for t in texts)
    assert {t.tobytes().decode() for t in texts} <= {t for _, t, _ in rows}


def test_chunks_cover_the_text():
    for n in (0, 1, 31, 32, 33, 256, 257, 480, 481, 10_000):
        starts = quality.chunk_starts(n)
        assert starts[0] == 0 and starts[-1] + quality.CHUNK >= n
        assert quality._weights(n, starts).sum() == pytest.approx(1)


PAGES = "page_id long, url string, html string, payload string, digest string, host string"


def test_warc(spark):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5\r\nX: y", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (7, "é", "é" * 300_000), (None, "u", "same"), (9, "u", "one"), (9, "u", "one")]
    found = warc.archive_round_trip(spark.createDataFrame([(*r, "p", "d", "h") for r in rows], PAGES)).collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = max(x for x, _, t in rows if (t or "") == (h or "") and x is not None)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


class _File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, at):
        return bytes(self.getbuffer()[at : at + n])


def test_warc_forms():
    import gzip

    rows = [{"record_id": f"urn:{k}", "record_type": t, "target_uri": "u", "date": "d", "payload_digest": "sha1:x", "refers_to": None, "payload_length": len(p), "payload": p} for k, (t, p) in enumerate([("response", b"a" * 200_000), ("response", b"\r\n\r\nWARC/1.1"), ("revisit", b"zz"), ("response", b"")])]
    raw = [warc.record_bytes(r) for r in rows]
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw)), b"".join(map(warc.gzip_member, raw))):
        got = list(warc.read_records(_File(data), lambda r: True, True))
        assert not any(r["damage"] for r in got)
        assert [(r["record_id"], r["payload_length"], r["payload"]) for r in got] == [(r["record_id"], r["payload_length"], None if r["record_type"] == "revisit" else r["payload"]) for r in rows]
        assert [r["record_id"] for r in warc.read_records(_File(data), lambda r: r["record_type"] == "revisit", True)] == ["urn:2"]
        assert all(r["payload"] is None for r in warc.read_records(_File(data), lambda r: True, False))
    assert gzip.decompress(warc.gzip_member(raw[0])) == raw[0]


def _damage(data, **options):
    return [(r["record_id"], r["damage"] is not None, len(r["payload"] or b"")) for r in warc.read_records(_File(data), lambda r: True, True, True, **options)]


def test_damaged_warc():
    import gzip

    rng = np.random.default_rng(1)
    rows = [{"record_id": f"urn:{k}", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": "sha1:x", "refers_to": None, "payload_length": 50_000, "payload": rng.bytes(50_000)} for k in range(3)]
    raw = [warc.record_bytes(r) for r in rows]
    for form in (lambda x: x, gzip.compress, warc.gzip_member):
        parts = [form(x) for x in raw]
        cut = b"".join(parts)[:-20_000]
        assert [(i, d) for i, d, _ in _damage(cut)] == [("urn:0", False), ("urn:1", False), ("urn:2", True)] and _damage(cut)[-1][2] < 50_000
        with pytest.raises(ValueError, match="damaged record at byte"):
            list(warc.read_records(_File(cut), lambda r: True, True))
        head = parts[0] + form(raw[1][:100])
        assert _damage(head) == [("urn:0", False, 50_000), (None, True, 0)]
        bad = raw[1].replace(b"Content-Length: ", b"Content-Length: x", 1)
        assert [(i, d) for i, d, _ in _damage(parts[0] + form(bad) + parts[2])] == [("urn:0", False), ("urn:1", True), ("urn:2", False)]
    for form in (gzip.compress, warc.gzip_member):
        parts = [bytearray(form(x)) for x in raw]
        parts[1][20_000:20_100] = bytes(100)
        found = _damage(b"".join(parts))
        assert found[0] == ("urn:0", False, 50_000) and found[-1] == ("urn:2", False, 50_000) and any(d for _, d, _ in found)


def test_base32_sha1(spark):
    rows = [(k, np.random.default_rng(k).bytes(k * 7)) for k in range(60)]
    for r in spark.createDataFrame(rows, "k long, x binary").select("k", "x", warc.base32_sha1("x").alias("d")).collect():
        assert r["d"] == base64.b32encode(hashlib.sha1(bytes(r["x"])).digest()).decode()


def test_url_filter(spark):
    from grainmill.llm.urlfilter import judge

    link = '<a href="https://bad.net/x">x</a><img src=//bad.net/i>'
    rows = [(1, "http://bad.net/", ""), (2, "HTTP://X.Bad.NET/a?b", ""), (3, "http://a.example.net/en/1", ""), (4, "http://a.example.net/eno", ""), (5, "http://example.com/de/", ""), (6, "http://y.org/fr/q#f", ""), (7, None, None), (8, "no scheme", ""), (9, "http://z.com", ""), (10, "http://sus.com/", link * 9), (10, "http://sus.com/", link), (None, "http://net/", ""), (11, "http://bad.net/z", ""), (12, "http://other.net", "")]
    found = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(spark.createDataFrame([(*r, "p", "d", "h") for r in rows], PAGES)).collect()}
    assert {(1, "bad.net", "/", "net/", "block"), (2, "x.bad.net", "/a", "net/", "block"), (3, "a.example.net", "/en/1", "example.net/en/", "allow"), (4, "a.example.net", "/eno", "net/", "block"), (5, "example.com", "/de/", "example.com/de/", "block"), (6, "y.org", "/fr/q", "org/fr/", "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "z.com", "", None, "allow"), (None, "net", "/", "net/", "block")} <= found
    assert {(i, v) for i, _, _, _, v in found if i in (10, 11, 12)} == {(10, "block"), (11, "block"), (12, "allow")}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {"op2_warc_round_trip", "op5_exact_top_k", "op9_url_filter"}))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    from oracle import assert_matches

    assert_matches(spark, sf_dir, entry.queries()[name], entry.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = p.good_quality(spark, docs, sf_dir)
    ids = {r["doc_id"] for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(texts) == ids and good.columns == p.COLUMNS
    single = p.without_copies(spark, good, sf_dir)
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    assert {r["doc_id"] for r in single.collect()} == set(first.values())
    apart = p.without_near_copies(spark, single, sf_dir)
    near = brute_near([(i, texts[i], "") for i in sorted(first.values())])
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, _, c in near if i == c)
    assert p.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
