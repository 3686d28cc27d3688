"""Encoding, percentiles, mixing, hand-written files and reading levels."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import encode, handwritten, mixture, percentiles, queries, reading

from .. import compare

VOCAB = os.path.join(encode.VOCABULARIES, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")


@needs_vocabulary
def test_encoding_equals_the_plain_one():
    e = encode.encoder(VOCAB)
    r = random.Random(1)
    alphabet = list("abc XYZ'st\n\t\r 0123.,!?-_(){}") + ["é", "ß", "日", "本", "\u00a0", "\u3000", "\u2028", "🙂", "\u0301", "'ll", "'s", "<|endoftext|>", "  ", "\x85", "\x1c"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(0, 60))) for _ in range(3000)] + [None, "", "a" * 100_000, " " * 1000, "'" * 50]
    ids, offsets = e.encode_texts(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == (e.encoding.encode_ordinary(t) if t else []), repr(t)


@needs_vocabulary
def test_encoding_round_trip_and_cases(spark):
    df = spark.createDataFrame([(1, "Ünïcode <|endoftext|>", 1), (2, None, 1), (3, "", 1), (3, "", 1)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r.ids for r in encode.encode(df).collect()}
    assert encode.encoder(VOCAB).encoding.decode(rows[1]) == "Ünïcode <|endoftext|>" and 50256 not in rows[1]
    assert rows[2] == [] and rows[3] == [] and encode.encode(df).count() == 4
    assert encode.encode(df.limit(0)).count() == 0


# ---- percentiles
@pytest.mark.parametrize("name", ["p4_latency", "p4_latency_merged", "p4_savings", "p4_states"])
def test_percentiles_match_sql(spark, data, name):
    c = compare.connect(data)
    got, want = compare.spark_rows(queries.queries()[name](spark, data)), compare.sql_rows(c, queries.oracle_sql()[name])
    assert got == want


def test_percentiles_of_one_hot_group_over_many_ranges(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "x").alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("x", None), ("x", float("nan")), ("e", None)], "g string, v double"))
    rows = {r.g: r for r in percentiles.percentiles(percentiles.value_counts(df, ["g"], "v"), ["g"], parts=7).collect()}
    for g in ("x", None):
        v = sorted(float((k * 7919) % 1000) for k in range(5000) if (k % 3 == 0) == (g == "x"))
        for c, p in percentiles.TARGETS.items():
            assert rows[g][c] == v[max(1, -(-p * len(v) // 1000)) - 1]
    assert "e" not in rows


def test_percentiles_with_groups_over_many_batches(spark):
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        r = random.Random(6)
        rows = [(r.choice(["a", "a", "a", "b", None, "d", "e"]), r.choice([1, 2, None]), float(r.randrange(90))) for _ in range(3000)]
        df = spark.createDataFrame(rows, "g string, h int, v double")
        for parts in (1, 4, 13):
            got = {(x.g, x.h): x for x in percentiles.percentiles(percentiles.value_counts(df, ["g", "h"], "v"), ["g", "h"], parts=parts).collect()}
            want: dict = {}
            for g, h, v in rows:
                want.setdefault((g, h), []).append(v)
            assert len(got) == len(want)
            for key, v in want.items():
                v.sort()
                assert got[key].n == len(v) and all(got[key][c] == v[max(1, -(-p * len(v) // 1000)) - 1] for c, p in percentiles.TARGETS.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)


def test_states_merge_and_stay_within_the_error(spark):
    a, b = spark.range(0, 700), spark.range(700, 1000)
    v = lambda d: d.select(F.lit("g").alias("g"), (F.exp(F.col("id") / 100.0)).alias("v"))
    whole = percentiles.value_counts(v(a.union(b)), ["g"], "v", digits=3)
    merged = percentiles.merge(percentiles.value_counts(v(a), ["g"], "v", digits=3), percentiles.value_counts(v(b), ["g"], "v", digits=3))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    got = percentiles.percentiles(merged, ["g"]).first().p50
    assert abs(got / np.exp(4.99) - 1) < 0.006
    assert percentiles.percentiles(whole.limit(0), ["g"]).count() == 0


# ---- mixing
def test_flight_keeps_both_totals():
    r = random.Random(2)
    docs = [(k, r.randrange(1, 500), 0.3) for k in range(2000)]
    f, out = mixture.Flight(1), []
    for d in docs:
        out += f.add(*d)
    left = sum(p * t for _, t, p in f.open)
    assert abs(sum(t * x for _, t, x in out) + left - 0.3 * sum(t for _, t, _ in docs)) < 1e-3
    assert abs(sum(x for *_, x in out) + sum(p for *_, p in f.open) - 600) < 1e-6 and len(f.open) <= 2


@needs_vocabulary
def test_mixture(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choices(["alpha", "beta", "gamma ray"], k=r.randrange(5, 60))), "big" if k < 600 else "small" if k < 660 else None if k % 2 else "other", 1) for k in range(700)]
    rows += [(1000, None, "big", 1), (1001, "", "small", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(3, "doc_id")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mixture(docs, targets)
    got = mixed.collect()
    assert len({x.doc_id for x in got}) == len(got) and max(x.copies for x in got if x.source == "small") <= 3 and max(x.copies for x in got if x.source == "big") == 1
    assert {x.source for x in got} == {"big", "small"}
    share = {x.source: x.share for x in mixture.report(mixed, targets).collect()}
    assert abs(share["big"] - 0.6) < 0.005 and abs(share["small"] - 0.4) < 0.005
    assert sorted(map(tuple, mixture.mixture(docs, targets).collect())) == sorted(map(tuple, got))
    assert mixture.mixture(docs.limit(0), targets).count() == 0


@needs_vocabulary
def test_mixture_lands_in_rounds(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(k, "word " * r.randrange(1, 80), "big" if k < 900 else "small") for k in range(1000)], "doc_id long, text string, source string").repartition(12, "doc_id")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2)], "source string, target_share double, max_repeats int")
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixture.mixture(docs, targets, fan=2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tokens = {s: sum(x.n_tokens * x.copies for x in got if x.source == s) for s in ("big", "small")}
    assert len({x.doc_id for x in got}) == len(got) and abs(tokens["big"] / sum(tokens.values()) - 0.7) < 0.003
    assert max(x.copies for x in got if x.source == "big") == 1 and max(x.copies for x in got if x.source == "small") <= 2


def test_settle_long_keeps_the_expected_tokens():
    items = [(1, 50_000, 0.5), (2, 20_000, 0.4), *((k, 100, 0.5) for k in range(3, 2003))]
    out, rest = mixture.settle_long(items, 3)
    assert [x[0] for x in out] == [1, 2]
    assert abs(sum(t * k for _, t, k in out) + sum(t * p for _, t, p in rest) - sum(t * p for _, t, p in items)) < 1e-3


# ---- hand-written files
LIB = "\n".join(f"def part_{k}(values, limit_{k}):\n    kept_{k} = [v for v in values if v > {k}]\n    return kept_{k}[:limit_{k}]\n" for k in range(20))
OWN = "\n".join(f"def step_{k}(rows, size):\n    while rows and len(rows) > size + {k * 3}:\n        rows = rows[{k}:]\n    return sum(rows) * {k}\n" for k in range(20))


def test_hand_written(spark):
    gen = "# Code generated by x. DO NOT EDIT.\n"
    rows = [(k, f"p{k % 4}", f"lib/copy{k}.py", ("# note\n" if k % 2 else "") + LIB) for k in range(4)]
    rows += [(10, "p1", "a.py", OWN), (11, "p1", "again.py", OWN), (12, "p2", "g.py", gen + OWN), (13, "p2", "vendor/x.py", OWN.replace("step", "move")), (14, "p2", "n.py", f"B = '{gen.strip()}'\n" + OWN.replace("rows", "xs")), (15, "p2", "d.js", "const t = [" + ",".join(str(k) for k in range(900)) + "];\n"), (16, "p2", "m.js", "function a(b){if(!b)return 1;return b.map(function(c){return c+1})}" * 60), (17, "p2", "e.py", ""), (18, "p2", "z.py", None), (19, None, None, "x = 1"), (20, "p3", "k.js", "// This file was generated once and is now kept by hand.\nf();\n")]
    df = spark.createDataFrame(rows, "file_id long, project_id string, file_path string, content string")
    got = {r.file_id: r.reason for r in handwritten.not_handwritten(df.unionByName(df.limit(3))).collect()}
    assert got == {0: "vendored", 1: "vendored", 2: "vendored", 3: "vendored", 12: "generated", 15: "data", 16: "minified"}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def test_shapes_that_only_look_generated():
    rx = "const rx = /[)\\]}\"'`]+/g;\n" + "\n".join(f"function f{k}(a) {{\n  if (!a) {{\n    throw new Error('e{k}');\n  }}\n" + "  a.push(1);\n" * (k % 3) + f"  const n{k} = a.length + 1;\n  return a.filter((x) => x !== n{k});\n}}" for k in range(40))
    table = "T = (\n" + "\n".join(f'    ({k}, "a{k}", "b"),' for k in range(60)) + "\n)\n\ndef get(k):\n    return T[k]\n"
    assert handwritten.examine("p", "a.js", rx)[0] is None
    assert handwritten.examine("p", "a.py", table)[0] is None
    assert handwritten.examine("p", "a.py", table.split("def")[0])[0] == "data"


def test_repeated_forms_with_many_endings():
    getters = "class A:\n" + "\n".join(f"    def get_field_{k}(self):\n        return self._field_{k}\n" for k in range(39))
    go = "package m\n\n" + "\n".join(f"func (m *M) GetField{k}() int {{\n\treturn m.field{k}\n}}" for k in range(39))
    assert handwritten.examine("p", "a.py", getters)[0] == "repeated"
    assert handwritten.examine("p", "a.go", go)[0] == "repeated"


def test_repeated_forms_at_the_limit():
    pairs = [f"f(a{k})\ng = a{k}" for k in range(40)]
    for others, want in ((20, True), (21, False)):  # 80 of 100 rows, and of 101
        text = "\n".join(pairs + [f"h{'(' * (k + 1)}b{k}" for k in range(others)])
        assert handwritten._repeats(text) is want


def test_copied_json(spark):
    def made(seed):
        r = random.Random(seed)
        return "{\n" + ",\n".join(f'  "{r.choice("abcdef")}{r.randrange(10**6)}": {{"type": "{r.choice(["string", "object"])}", "title": "T{r.randrange(10**6)}"}}' for _ in range(60)) + "\n}\n"

    schema, vendored = made(1), made(2)
    rows = [(k, f"p{k}", "schema.json", schema) for k in range(3)] + [(10 + k, f"p{k}", "vendor/x/package.json", vendored) for k in range(2)]
    rows += [(20 + k, f"p{k}", "own.json", made(20 + k)) for k in range(3)] + [(30 + k, f"p{k}", "twice.json", made(3)) for k in range(2)]
    df = spark.createDataFrame(rows, "file_id long, project_id string, file_path string, content string")
    assert {r.file_id: r.reason for r in handwritten.not_handwritten(df).collect()} == dict.fromkeys([0, 1, 2, 10, 11], "vendored")


def test_short_copies(spark):
    def made(name):
        return f"def {name}(a, b):\n    c = a + b\n    for k in range(c):\n        a = a * k - b\n    if a > b:\n        return a\n    return {name}(b, c)\n"

    many, few, tiny = made("many"), made("few"), "def f(a):\n    return a\n"
    n = handwritten.SHORT_PROJECTS
    rows = [(k, f"p{k}", f"a{k}.py", "# ours\n" * (k % 2) + many) for k in range(n)] + [(10, "p0", "again.py", many), (11, "p0", "vendor/x/a.py", many)]
    rows += [(20 + k, f"p{k}", "few.py", few) for k in range(n - 1)] + [(30, "p0", "few2.py", few)]
    rows += [(40 + k, f"p{k}", "tiny.py", tiny) for k in range(n)] + [(50 + k, f"p{k}", "own.py", made(f"own{k}")) for k in range(n)]
    page = "<!DOCTYPE html>\n<html><head><title>404</title></head>\n<body><h1>Not Found</h1>\n<p>The page is gone.</p>\n</body></html>\n"
    rows += [(60 + k, f"p{k}", "page.py", page) for k in range(n)]
    df = spark.createDataFrame(rows, "file_id long, project_id string, file_path string, content string")
    assert 0 < len(handwritten.examine("p", "a.py", many)[2]) < handwritten.LEAST
    got = [r.file_id for r in handwritten.not_handwritten(df.unionByName(df.limit(3))).collect()]
    assert sorted(got) == [*range(n), 10, 11]


def test_winnowing_finds_every_long_common_run():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 40, 300)
    b = np.concatenate([r.integers(0, 1 << 40, 50), a[100:200], r.integers(0, 1 << 40, 50)])
    assert set(handwritten.fingerprints(a).tolist()) & set(handwritten.fingerprints(b).tolist())
    assert len(handwritten.fingerprints(a[: handwritten.SHINGLE - 1])) == 0


def test_heads_alone_do_not_make_third_party_or_generated():
    for h in ("// Taken unchanged from foo 1.2.3.", "// Copyright The Foo Bar Authors", "// it once lived under vendor/, it is ours now", "// This file was generated once and is now kept by hand."):
        assert handwritten.examine("p", "a.js", h + "\n" + OWN)[0] is None
    said = "# Generated on 2024-1-1 by the report compiler v1.2\n" + "\n".join(f"def get_{k}(self):\n    return self.field({k})" for k in range(30)) + "\n" + "\n".join(f"h{'(' * k}" for k in range(25))
    assert handwritten.examine("p", "a.py", said)[0] == "generated"
    assert handwritten.examine("p", "a.py", said.split("\n", 1)[1])[0] is None


def test_blobs_of_any_number_of_tokens():
    r = random.Random(5)
    blob = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=900))
    words = "|".join(f"{a}_{b}" for a in ("open", "read", "close", "merge") for b in ("file", "index", "route", "symbol", "folder", "ledger"))
    assert handwritten.examine("p", "a.py", f'DATA = "{blob}"')[0] == "data"
    assert handwritten.examine("p", "a.js", f"module.exports = '{blob[:120]}';")[0] == "data"
    assert handwritten.examine("p", "a.py", f'HASH = "{"0f3a" * 30}"')[0] == "data"
    assert handwritten.examine("p", "a.py", f'PATTERN = "{words}"')[0] is None
    assert handwritten.examine("p", "a.py", 'TITLE = "A sentence that someone wrote for people to read, and nothing else."')[0] is None


# ---- reading levels
EASY = ["The user opens the file.", "A box holds the test.", "The line stops a job.", "Each name moves the page."]
PLAIN = ["The team reads the report and the server sends the message.", "A test finds the bug but the tool keeps the old name.", "The user opens the page and then the box moves the file."]
WORK = ["The parser compares each schema in the local index because the current session updates the column.", "While the module extends the configuration, each reader measures the symbol when the branch returns."]
HARD = [
    "Consequently, the probabilistic reconciliation presupposes a heterogeneous parameterization of the longitudinal serialization, notwithstanding the fact that the asymptotic representation necessitates a combinatorial materialization.",
    "The deterministic canonicalization substantiates the hierarchical generalization, insofar as the architectural interoperability circumscribes the referential nondeterminism.",
]
STRUNG = [" and ".join(x.rstrip(".") for x in EASY[: k % 3 + 2] * (k + 1)) + "." for k in range(5)]
KINDS = {1: EASY, 2: PLAIN + STRUNG, 3: WORK, 4: HARD}


def _corpus(r, n):
    out = []
    for k in range(n):
        level = k % 4 + 1
        out.append((k, " ".join(r.choice(KINDS[level]) for _ in range(6)), level))
    return out


def test_levels_on_held_out_documents(spark):
    r = random.Random(4)
    rows = _corpus(r, 240)
    extra = [(900, None), (901, ""), (902, "```\n" + HARD[0] + "\n```"), (903, " ".join(EASY * 3 + HARD[:1])), (904, " and ".join(x.rstrip(".") for x in EASY * 4) + "."), (905, "# " + HARD[0])]
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows] + [(k, t, 1) for k, t in extra], "doc_id long, text string, level int")
    labels = spark.createDataFrame([(k, min(4, max(1, v + (1 if k % 17 == 0 else 0)))) for k, _, v in rows[:120]] + [(3, None)], "doc_id long, reading_level int")
    got = {x.doc_id: x.level for x in reading.reading_levels(docs, labels).collect()}
    right = sum(got[k] == v for k, _, v in rows[120:])
    assert right >= 108 and all((got[k] == 4) == (v == 4) for k, _, v in rows[120:])
    assert got[900] is None and got[901] is None and got[902] is None and got[905] is None
    assert got[903] == 1 and got[904] != 4


def test_labelled_documents_without_sentences(spark):
    rows = [(k + 10, t, v) for k, t, v in _corpus(random.Random(4), 160)]
    empty = [(0, "", 1), (1, "  \n", 4), (2, "```\n" + HARD[0] + "\n```", 4)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in empty + rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, v) for k, _, v in empty + rows[:80]], "doc_id long, reading_level int")
    got = {x.doc_id: x.level for x in reading.reading_levels(docs, labels).collect()}
    assert all((got[k] == 4) == (v == 4) for k, _, v in rows[80:])
    assert [got[k] for k in range(3)] == [None] * 3


def test_parsing_and_medians():
    p = reading.parse(["The user opens the file.\nA box holds the test.", None, "", "# The user opens the file"])
    assert p.sentences.tolist() == [2, 0, 0, 0] and p.words.tolist() == [10, 0, 0, 0] and p.sizes.tolist() == [5, 5]
    assert reading.sentences("Call `f()` with fooBar, then the next one stops; x_y.") == [["call", "with", "then", "the", "next", "one", "stops"]]
    r = np.random.default_rng(3)
    x, counts = r.normal(size=(40, 3)), np.array([0, 1, 2, 7, 0, 30])
    ends = np.cumsum(counts)
    assert np.allclose(reading.medians(x, counts), [np.median(x[e - c : e], axis=0) if c else np.zeros(3) for c, e in zip(counts, ends)])
    rare = reading.rarities([(0, 100), (8, 50), (12, 2)])
    assert rare.of(np.array([8, 12, 16])).round(3).tolist() == [0.151, 0.849, 0.849]


def test_ordinal_finds_its_weights():
    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 3))
    score = x @ [2.0, -1.0, 0.0] + r.logistic(size=6000)
    y = 1 + (score[:, None] > [-2.0, 0.0, 1.5]).sum(1)
    m = reading.Ordinal(1e-6).fit(x, y, np.ones(6000))
    assert np.allclose(m.weights / m.scale, [2.0, -1.0, 0.0], atol=0.12) and np.allclose(m.cuts - (m.mean / m.scale) @ m.weights, [-2.0, 0.0, 1.5], atol=0.15)


def test_levels_without_labels(spark):
    docs = spark.createDataFrame([(1, "The user opens the file and the box.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, reading_level int")
    assert reading.reading_levels(docs, labels).first().level is None


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    if name in ("p7_ids", "p8_mixture", "p8_report") and not os.path.exists(VOCAB):
        pytest.skip("no vocabulary")
    df = queries.queries()[name](spark, data)
    assert df.columns and df.count() >= 0
