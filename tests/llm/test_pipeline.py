"""The corpus pipeline, stage by stage: planted cases, and brute force on a corpus with nulls, repeated rows and clashing columns."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import pyarrow as pa
from meshloom.llm import common, packing, simhash, tokens, toxicity
from test_operators import brute_fingerprint, brute_logit, brute_spans, expected_ids


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = words(30)
    rows = [(k, words(60) + (" vile vile foul" if k % 6 == 0 else ""), "en", "s", 0) for k in range(600)]
    rows += [(1001, rows[1][1], "en", "s", 0), (1002, words(20) + " " + item + " " + words(9), "en", "s", 0), (1003, words(40) + " write to a.b@c.org now", "en", "s", 0), (1004, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in left.items()}
    assert ids["toxicity"] == {r[0] for r in rows if r[0] >= 600 or r[0] % 6}
    assert ids["toxicity"] - ids["simhash_near_dedup"] == {1001}
    assert ids["simhash_near_dedup"] - ids["decontamination"] == {1002}
    assert ids["pii"] == ids["decontamination"] == ids["packing"]
    assert next(r.text for r in left["pii"] if r.doc_id == 1003).endswith("write to [email] now")
    plain = packing.pieces(spark.read.parquet(f"{tmp_path}/pii"))
    assert sorted(map(tuple, left["packing"])) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect())) == sorted({(r.doc_id, r.doc_tokens) for r in left["packing"]})


def masked(text):
    """Base spans replaced; the first of those that overlap, the longer one at a tie, stands for all."""
    spans = sorted((int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in brute_spans(text).split(",") if x))
    out, at = "", 0
    for a, minus, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, -minus)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(18)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item = words(24)
    texts = [(k, words(30) + (" vile vile foul" if k % 5 == 0 else "")) for k in range(300)]
    texts += [(400, texts[1][1]), (0, texts[2][1]), (401, None), (402, ""), (403, item + " " + words(4)), (404, words(9) + " a.b@c.org +1 743 555 3824 1.2.3.4 or 4465758382889437 " + words(3)), (404, words(9) + " x@y.example.net"), (None, "null id vile vile foul"), (None, "null id z@y.org"), (None, "null id z@y.org"), (405, texts[3][1].replace("w", "W")), (406, "one"), (407, "ONE")]
    texts += [texts[7], texts[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, old string, row_id int, h1 int, found string"
    rows = [(i, t, ["en", None][k % 2], "s", len(t or ""), "o", k, 1, "f") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model, given = toxicity.train(docs, labels), [tuple(r) for r in docs.collect()]
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30, min(30, model.scale[0] * x + model.scale[1]))))
    score = lambda t: sigmoid(brute_logit(model, toxicity.rows_of([t])[0]))

    def contaminated(text):
        bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
        w, asked = (text or "").lower().split(), item.split()
        n = min(len(asked), len(w))
        return n >= 5 and any(sum((a & b).values()) >= 0.8 * sum((a | b).values()) for p in range(len(w) - n + 1) for a, b in [(bag(asked), bag(w[p : p + n]))])

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            want = [r for r in given if score(r[1]) < model.thresholds.get(r[2], toxicity.THRESHOLD)]
            assert 30 < len(given) - len(want) < 90
        elif name == "simhash_near_dedup":
            prints = {r[1]: brute_fingerprint(r[1]) for r in given}
            group = {f: f for f in prints.values()}
            for _ in range(4):
                for a in group:
                    for b in group:
                        if (a ^ b).bit_count() <= 2:
                            group[a] = group[b] = min(group[a], group[b])
            of = lambda r: group[prints[r[1]]]
            least = {}
            for r in given:
                if r[0] is not None:
                    least[of(r)] = min(r[0], least.get(of(r), r[0]))
            ids = Counter((of(r), r[0]) for r in got if r[0] is not None)
            # one row of each group, with its smallest id; all without an id
            assert ids == Counter({(g, i): 1 for g, i in least.items()}) and Counter(got) <= Counter(given)
            want = [r for r in got if r[0] is not None] + [r for r in given if r[0] is None]
        elif name == "decontamination":
            want = [r for r in given if not contaminated(r[1])]
            assert len(given) - len(want) == 1
        elif name == "pii":
            new = {r: r[1] and masked(r[1]) for r in given}
            want = [(r[0], new[r], *r[2:4], r[4] if new[r] == r[1] else len(new[r]), *r[5:]) for r in given]
            assert sum(r != n for r, n in zip(given, want, strict=True)) >= 3
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")] and Counter(got) == Counter(want)
            given = got
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    sizes = Counter()
    for r in got:
        sizes[r[0]] += r[2]
    want_sizes = Counter()
    for r in given:
        want_sizes[r[0]] += len(expected_ids("byte_bpe_50k.json", r[1])) + 1
    assert sizes == want_sizes and re.fullmatch(r"[a-z0-9_,]+", ",".join(docs.columns))


def test_stages_bound_what_a_worker_holds(spark, monkeypatch):
    key, none = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    texts = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    try:
        for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.mask_personal_data, corpus_pipeline.pack):
            spark.conf.unset(key)
            stage(spark, none, "")
            got = texts.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 400 and max(r.size for r in got) < common.BATCH_BYTES + 50_000
            spark.conf.set(key, "1m")
            stage(spark, none, "")
            assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    # tables of powers stay small, whatever the texts are long together
    monkeypatch.setattr(common, "_powers", [])
    common.hashed_words([b"word " * 1000] * 1000)
    assert len(common._powers[0]) <= 2 * common.HASHED_BYTES
    # an operator that doesn't encode drops the encoders that an earlier stage left in its worker
    tokens.encoder("byte_bpe_50k.json")
    (out,) = simhash._fingerprints(iter([pa.record_batch([pa.array([1]), pa.array([b"one two"])], names=["doc_id", "body"])]))
    assert out.num_rows == 1 and not tokens._encoders
