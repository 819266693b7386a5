"""The edit queries over whole tables, against a plain matrix."""

import random

from grainmill import catalogue

rnd = random.Random(11)


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_turns_of_any_size(spark, tmp_path):
    long = "".join(rnd.choice("abc é") for _ in range(700))
    texts = {(1, 0): long, (1, 1): long[:300] + "x" + long[301:], (1, 2): "short", (1, 3): long, (2, 0): "a" * 401, (2, 1): "a" * 400, (2, 2): "", (3, 0): "é", (3, 1): "e", (4, 7): "alone", (5, 0): "b" * 20, (5, 1): "b" * 24_001}
    spark.createDataFrame([(c, t, x) for (c, t), x in texts.items()], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = {k: (x.encode(), texts[k[0], k[1] - 1].encode()) for k, x in texts.items() if (k[0], k[1] - 1) in texts}
    want = {k: distance(*p) for k, p in pairs.items()}
    found = {(r["conv_id"], r["turn"]): r["distance"] for r in catalogue.queries()["q_edit_distance"](spark, str(tmp_path)).collect()}
    assert found == want
    gates = {(r["conv_id"], r["turn"]): r["worth"] for r in catalogue.queries()["q_edit_gate"](spark, str(tmp_path)).collect()}
    assert gates == {k: abs(len(a) - len(b)) <= 4000 and 4 * want[k] + 4 <= len(a) for k, (a, b) in pairs.items()}
    assert gates[1, 1] and gates[2, 1] and not gates[1, 2]
