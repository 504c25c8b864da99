"""The text operators against brute force: on nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import chat, decontaminate, embedding, packing, pii, simhash, substring, token_files, tokens, toxicity, urlfilter
from meshloom.llm.common import hashed_words, new_path, rolled

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp string, kind string, value int, ids string, part string, label string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma,", "dé", "of", "the", "zu", "x1"]) + str(rng.randrange(40)) for _ in range(n))
    base, passage = some(60), some(30)
    texts = [(1, base), (2, None), (3, ""), (4, base), (5, base.replace("alpha", "alpha ", 1)), (6, base + " tail"), (7, some(20) + " " + passage + " " + some(5)), (8, passage), (9, some(8) + "\n\n" + passage), (1, base), (1, base)]
    texts += [(None, passage), (None, None), (10, "  \t\n "), (11, "word " * 3000), (12, "x" * 50_000), (13, "one two"), (14, some(13)), (15, "ONE TWO"), (16, "mail a@b.c_d@e.f or +1 (743) 555-3824, 1.2.3.4.5.6.7.8 4465758382889437 <|endoftext|>")]
    texts += [(k, some(25)) for k in range(20, 40)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "f", "k", 2, "i", "p", "l") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_vector_hashes_follow_words():
    bodies = [b"", b"a bb  a\n", b" ", "é a".encode(), b"abcd abcde abcd"]
    h, counts = hashed_words(bodies, stems=(4,))
    assert counts.tolist() == [0, 3, 0, 2, 3] and h[0, 0] == h[2, 0] == h[4, 0] and h[1, 0] != h[0, 0]
    assert h[0, 1] == 0 and h[5, 1] == h[6, 1] != 0
    long = [b"w%d " % (k % 7) * 200_000 for k in range(2)]
    h, counts = hashed_words(long)
    assert counts.tolist() == [200_000, 200_000] and len(set(h.tolist())) == 2
    a = np.arange(20, dtype=np.uint64)
    assert rolled(a, 13, 3)[0] == sum(int(x) * 3 ** (12 - k) for k, x in enumerate(a[:13])) % 2**64


def brute_remove(rows, window):
    first: dict = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[p : p + window])] = min(i, first.get(tuple(w[p : p + window]), i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        yield i, len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y).encode()


def test_substring(docs, none):
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_remove(corpus(), 13), key=repr)
    assert substring.remove_repeats(none).collect() == []


@pytest.mark.parametrize("window", [13, 5, 1])
def test_substring_of_many_overlaps(spark, window):
    """Few words, so that windows of every level repeat, at the ends of texts too; passages of 12 to 30 words with other neighbours."""
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(30)}" for _ in range(n)] for n in (window - 1, window, window + 1, 20, 30)]
    rows = []
    for k in range(120):
        w = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            w += [f"q{rng.randrange(4)}" for _ in range(rng.randrange(4))] + p[rng.randrange(2) : len(p) - rng.randrange(2)]
        rows.append((rng.randrange(100) if k % 3 else k, " ".join(w)))
    rows = list(dict(rows).items())
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.remove_repeats(table, window).collect()]
    assert sorted(got) == sorted(brute_remove(rows, window))


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("paired", [128, 1])
def test_simhash(docs, none, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)  # both ways to search a bucket
    rows = [(i, brute_fingerprint(t)) for i, t in corpus()]
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least: dict = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(((i, f"{f:016x}", least.get(group[f])) for i, f in rows), key=repr)
    if paired == 128:
        kept = simhash.without_near_copies(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({least[group[f]] for i, f in rows if i is not None and least[group[f]] == i})
        assert simhash.near_duplicates(none).collect() == []


def test_near_copies_go_by_row(spark):
    """One row of each group stays, also where texts share a doc_id, rows are repeated, or columns clash."""
    t, u, v = "one two three four five", "six seven eight nine ten", "eleven twelve thirteen"
    rows = [(3, t, "a"), (5, u, "b"), (5, t, "c"), (7, u, "d"), (8, v, "e"), (8, v, "f"), (8, v, "f"), (None, t, "g"), (9, "", "h"), (10, None, "i")]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row string, h1 long, own long, n long").repartition(3)
    out = simhash.without_near_copies(table)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert out.columns == table.columns and got == sorted([(3, t), (5, u), (8, v), (9, ""), (None, t)], key=repr)
    assert simhash.without_near_copies(table.limit(0)).collect() == []


def test_simhash_random_pairs(spark):
    """Close pairs on all bits, also where two links chain."""
    rng = random.Random(1)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f, f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    values = [x for (x,) in signed]
    assert found == {(min(a, b), max(a, b)) for a in values for b in values if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokens.vocabulary(name))
    model.encode_special_tokens = True
    return model


def expected_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_ids(name, monkeypatch):
    odd = ["", " ", "  a", "a  b", "a \n b\n\n c", "x<|endoftext|>y z", "a　 b c\x1c d", "it's don't 'S", "ÉCOLE Σας ΣΑΣ İ x", "á é", "🙂 🙂🙂  ", "\0 a\0b c", "a. b, c.. d., é. 中. 1.", ".", ", ", " end ", "a.\nB.\n", "\na", "a\n b", "a ", " |", "b!!c &&& d%%%\nE", "7 8 77 a7b", "ÿ×÷ßÀ µª", "é" * 11 + " " + "x" * 23 + " " + "x" * 24, "x́ éa a ́"]
    odd += [t for _, t in corpus() if t]
    rng = random.Random(11)
    odd += ["".join(rng.choice(["a", "Bc", "é", "Ü", " ", " ", "\n", ".", ",", "!", "'", "s", "3", "\t", "中", "\xa0", "<", "|", "7", "ab" * 9]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    want = [expected_ids(name, t) for t in odd]
    for words, together in ((tokens.WORDS, tokens.TOGETHER), (4000, 500)):  # also where words must go again, and long texts are cut
        monkeypatch.setattr(tokens, "TOGETHER", together)
        model = tokens.Encoder(name, words)
        for _ in range(2):
            ids, bounds = model.encode([t.encode() for t in odd])
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == want


def test_words_go_when_the_table_is_full():
    model = tokens.Encoder("byte_bpe_50k.json", 64)
    for k in range(40):
        text = " ".join("".join(chr(97 + (k * 7 + j) // 26**i % 26) for i in range(4)) for j in range(20)) + " the the of"
        ids, _ = model.encode([text.encode()])
        assert ids.tolist() == expected_ids("byte_bpe_50k.json", text) and model.table.entries <= 64


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == parts[0].tier <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.doc_tokens, bytes(r.ids)))
    for i in {i for i, _ in corpus()}:
        want = Counter()
        for j, t in corpus():
            if i == j:
                want.update([np.array([*expected_ids("byte_bpe_50k.json", t), 0], "<u4").tobytes()])
        if sum(want.values()) == 1:
            (whole,) = want
            assert b"".join(x[2] for x in sorted(by_doc[i])) == whole and {x[1] for x in by_doc[i]} == {len(whole) // 4}
        assert sum(len(x[2]) for x in by_doc[i]) == sum(len(x) * n for x, n in want.items())
    assert packing.pack(none).collect() == []


def test_token_files(spark, docs, none):
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, path)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in corpus()), key=lambda i: -1 if i is None else i)
    at = 0
    want = Counter((i, tuple([*expected_ids("word_bpe_49k.json", t), 2])) for i, t in corpus())
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert token_files.read_tokens(spark, path, ("doc_id", "n_tokens")).columns == ["doc_id", "n_tokens"]
    import pyarrow.parquet as pq
    from pathlib import Path

    column = pq.ParquetFile(max(Path(path).glob("part-*"), key=lambda p: p.stat().st_size)).metadata.row_group(0)
    kinds = {column.column(k).path_in_schema: column.column(k).encodings for k in range(column.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"]) and "DELTA_BINARY_PACKED" in kinds["doc_id"] and column.column(0).has_column_index
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(none, empty)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_token_files_of_a_large_vocabulary(spark, monkeypatch):
    """Ids beyond 16 bits come back as they are."""
    monkeypatch.setattr(token_files, "vocabulary_size", lambda name: 100_000)
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), path, end_id=70_000)
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert got == {1: [*expected_ids("word_bpe_49k.json", "one two"), 70_000], 2: [70_000]}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base(spark, docs, none):
    texts = [*corpus(), (50, "ü" * 10 + "é.x@mail.example.com,𝒜 255.255.255.0255 +++12 ()()12345678 9"), (51, "1 " * 20_000), (52, "a" * 100_000), (53, "a@b." * 3 + "c +1 2 3 4 5 6 7 8 9) "), (54, "a@b-.c-@d.e 4111-1111-1111-1111 256.1.1.1")]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, kind string, base string")
    got = sorted(((r.doc_id, r.base, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.per_document(rows).collect()), key=repr)
    want = []
    for i, t in texts:
        s = brute_spans(t) if i != 52 else ""
        want.append((i, s, *[sum(x.startswith(k + ":") for x in s.split(",")) for k in BASE]))
    assert got == sorted(want, key=repr)
    assert pii.per_document(none).collect() == []


def test_pii_contexts_find_what_patterns_miss(spark):
    """'call me' stands before seven valid numbers; so what stands behind it in document 8 is one. 'count was' isn't reliable."""
    texts = [(k, f"please call me +1 743 555 10{k:02d} today") for k in range(7)] + [(8, "please call me (743) 555-9999 today"), (9, "the count was 7435551234 here")]
    texts += [(20 + k, f"the count was 74355512{k} here") for k in range(5)] + [(30, None), (31, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.per_document(rows).collect()}
    assert got[8].spans == "phone:15:29" and got[8].base == "" and got[8].n_context == 1
    assert all(got[k].n_phone == 1 and got[k].n_context == 0 for k in range(7)) and got[9].spans == "" and got[20].spans == ""
    masked = {r.doc_id: r.text for r in pii.masked(rows).collect()}
    assert masked[8] == "please call me [phone] today" and masked[0] == "please call me [phone] today" and masked[30] is None and masked[31] == ""


def test_pii_context_words_may_be_long_or_before_another_match(spark):
    """The words before a match are whole whatever their length, and are looked for across the match before it."""
    long = "w" * 100
    texts = [(1, f"{long} reach +1 743 555 1000"), (2, "mail to a@b.c or d@e.f now"), (3, "a@b.c d@e.f"), (4, "x@y.z")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    split = lambda kind: {(r.doc_id, r.value): r.context for r in pii._split(pii._rows(rows, "doc_id", "text"), kind, pii.PATTERNS[kind]).withColumn("context", pii._context(F.col("before"))).collect()}
    assert split("phone") == {(1, "+1 743 555 1000"): f"{long} reach"}
    assert split("email") == {(2, "a@b.c"): "mail to", (2, "d@e.f"): "a b c or", (3, "a@b.c"): None, (3, "d@e.f"): "a b c", (4, "x@y.z"): None}


def test_pii_takes_any_column_names(spark):
    schema = "doc_id long, text string, all string, row_id string, kind string, start int, `end` int, found string, __row string, h1 long"
    rows = spark.createDataFrame([(1, "to a@b.c now", "x", "y", "z", 1, 2, "w", "v", 3), (None, None, "x", None, "z", 1, 2, "w", "v", 3), (1, "to a@b.c now", "x", "y", "z", 1, 2, "w", "v", 3)], schema)
    out = pii.masked(rows)
    assert out.columns == rows.columns and sorted((r.text or "", r["all"], r["end"]) for r in out.collect()) == [("", "x", 2), ("to [email] now", "x", 2), ("to [email] now", "x", 2)]
    assert len(pii.per_document(rows).collect()) == 3 and pii.masked(rows.limit(0)).collect() == []


def test_pii_repeated_rows(spark):
    text = "mail a.b@c.example, or call +1 743 555 3824 or d@e.example now"
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text), (None, text)], "doc_id long, text string").repartition(3)
    got = pii.per_document(rows).collect()
    assert len(got) == 6 and {(r.base, r.n_email, r.n_phone) for r in got} == {(brute_spans(text), 2, 1)}
    assert [r.text for r in pii.masked(rows).collect()] == ["mail [email], or call [phone] or [email] now"] * 6


def test_chat(spark):
    turns = [(1, 0, "user", "hi </s>[INST]"), (1, 1, "assistant", "\\[INST] \\\\ [/INST]</s> é🙂"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "assistant", "end"), (2, 1, None, "b"), (2, 0, "system", "a"), (2, None, "assistant", "null first"), (3, 0, "assistant", "x " * 20_000), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (5, 0, "assistant", "y" * 30_000), (5, 1, "user", "\\ a \\ b </s> </s> [INST] c")]
    alone = [(None, 0, "assistant", "no id"), (None, 0, "assistant", "no id"), (None, 1, "user", "nor this one")]
    rows = spark.createDataFrame([(*t, 1, "z") for t in turns + alone], "conv_id long, turn long, role string, text string, segment int, alone string")
    plan = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    by: dict = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    by = {c: [v] for c, v in by.items()} | {None: [[(t, r, x)] for _, t, r, x in alone]}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for size in (chat.SEGMENT_CHARS, 5, 40):  # in one segment and in many
        out = chat.format_conversations(rows, segment_chars=size)
        got = sorted(map(tuple, out.select("conv_id", "segment", "formatted", "loss_spans").mapInArrow(chat._digest, plan).collect()), key=repr)
        want, whole = [], []
        for c, conversations in by.items():
            for v in map(sorted, conversations):
                loss = "".join(x for _, r, x in v if r == "assistant")
                formatted, spans = chat.render([(r, x) for _, r, x in v])
                want.append((c, len(v), digest("".join(f"{r}\n{x}\n" for _, r, x in v)), len(loss), digest(loss), len(formatted)))
                encoded = library("byte_bpe_50k.json").encode(formatted, add_special_tokens=False)
                whole.append((c, formatted, encoded.ids, chat.mask(spans, encoded.offsets)[0]))
        assert got == sorted(want, key=repr)
        # joined, the segments are the conversation encoded once
        segments, joined = out.collect(), []
        for r in segments:
            if not r.segment:
                joined.append([r.conv_id, "", [], []])
            for k, part in enumerate((r.formatted, r.ids, r.in_loss), 1):
                joined[-1][k] += part
        assert sorted(map(tuple, joined), key=repr) == sorted(whole, key=repr)
        assert size > 40 or len(segments) > len(joined)
    assert chat.format_conversations(rows.limit(0)).collect() == []


def test_masks_meet_tokens():
    hit, spans = chat.mask([(2, 5), (7, 8)], [(0, 3), (3, 4), (3, 4), (4, 7), (7, 9)])
    assert hit == [True] * 5 and spans == [[2, 5], [7, 8]]


@pytest.mark.parametrize("tile", [4, 1024])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(k, (centre[k % 6] + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), int(k % 2)) for k in range(60)]
    rows += [(100, rows[0][1], 0), (100, rows[0][1], 0), (101, [2 * x for x in rows[0][1]], 0), (102, rows[0][1], 1), (103, rows[0][1], None), (104, None, 0), (105, [0.0] * 16, 0), (106, [float("nan")] * 16, 0), (107, [None] + [1.0] * 15, 0), (108, [float("inf")] * 16, 0), (109, [1.0, 2.0], 0), (110, [], 0), (111, [1e30] * 16, 0), (112, [1e-30] * 16, 0)]
    # ids that are null, or that different vectors share
    rows += [(None, rows[2][1], 0), (None, [-x for x in rows[0][1]], 0), (None, [-x for x in rows[0][1]], 0), (7, rows[1][1], 1), (7, [-x for x in rows[1][1]], 1)]
    table = spark.createDataFrame([(*r, 7, "q") for r in rows], "vec_id long, embedding array<float>, label int, n int, tile string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(table, tile=tile).collect()), key=repr)
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if ok else None)
    n = len(rows)
    link = [[a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93 for b in range(n)] for a in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if link[a][b]:
                    comp[a] = comp[b] = min((c for c in (comp[a], comp[b]) if c is not None), default=None)
    assert got == sorted(((rows[a][0], sum(link[a]), comp[a], comp[a] == rows[a][0] if rows[a][0] is not None else comp[a] is None) for a in range(n)), key=repr)
    assert embedding.near_vectors(table.limit(0)).collect() == []


def test_forest_connects_as_links_do():
    rng = np.random.default_rng(0)
    for _ in range(20):
        links = rng.random((12, 9)) < 0.12
        edges = embedding.forest(links, False)
        assert len(edges) <= 20 and all(links[e] for e in edges)

        def parts(pairs):
            group = list(range(21))
            for _ in range(21):
                for a, b in pairs:
                    group[a] = group[12 + b] = min(group[a], group[12 + b])
            return group

        assert parts(edges) == parts([tuple(x) for x in np.argwhere(links)])


def test_url_filter(spark):
    urls = ["http://Example.com/en/x", "https://www.example.com/en/", "http://a.example.net/es/1?q", "x.net/fr/", None, "", "http://example.com", "http://net/fr/", "http://casino.example.net/fr/1", "ftp://m.casino.example.net/x#y", "http://pills.example.org", "http://Ünder.org/p?://z.net/es/", "http://u@notcom/x", "http://a.com:80/", "a://b://c/d\ne", "://com/"]
    rows = [(k, u, "h", "p") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(table).collect()}
    for k, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = (max(fit)[1], max(fit)[2]) if fit else (None, "block" if any(host == x or host.endswith("." + x) for x in urlfilter.LISTED) else "allow")
        assert got[k] == (host, path, rule, verdict)
    assert urlfilter.judge(table.limit(0)).collect() == []


def test_url_filter_with_a_long_list(spark, monkeypatch):
    """A list of 100,000 hosts, in one cascade and in several, against plain membership."""
    rng = random.Random(9)
    names = [f"h{k}.{rng.choice(['shop', 'news'])}.example" for k in range(99_996)] + ["Top.Example", "com.", "x" * 300 + ".org", None, "", "h1.news.example"]
    have = {re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in names if x}
    hosts = [f"{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(200_000)}.{rng.choice(['shop', 'news'])}.example" for _ in range(3000)]
    hosts += ["top.example", "x.top.example", "stop.example", "example", "", "a." + "x" * 300 + ".org", "a" + "x" * 300 + ".org", "a." * 5000 + "top.example", ".top.example", "com.", "com"]
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)], "page_id long, url string")
    listed = spark.createDataFrame([(x, 1) for x in names], "host string, key int")
    want = {k: any(".".join(h.split(".")[j:]) in have for j in range(h.count(".") + 1)) for k, h in enumerate(hosts)}
    assert 500 < sum(want.values()) < 3000
    for size in (urlfilter.CASCADE_BYTES, 8_000):
        monkeypatch.setattr(urlfilter, "CASCADE_BYTES", size)
        got = urlfilter.judge(pages, (), listed).collect()
        assert {r.page_id: r.listed for r in got} == want and len(got) == len(hosts) and {r.verdict for r in got if r.listed} == {"block"}


def test_cascade_is_exact_over_its_universe(spark):
    keys = [(f"host{k}.example", k % 9 == 0) for k in range(3000)]
    cascade = urlfilter.build_cascade(spark.createDataFrame(keys, "key string, listed boolean"))
    assert len(cascade.levels) > 1 and cascade.listed([k for k, _ in keys]).tolist() == [x for _, x in keys]
    assert urlfilter.build_cascade(spark.createDataFrame([("a", False)], "key string, listed boolean")).listed(["a"]).tolist() == [False]


def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    items = [words(n) for n in (40, 40, 25, 14, 3, 80)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "..."), (0, " ".join(items[0]))], "item_id long, text string")
    near = items[5].copy()
    near[0] = near[-1] = "other"
    far = items[1].copy()
    far[10:30] = words(20)
    texts = [(1, " ".join(words(100) + items[0] + words(10))), (2, "Intro: " + ", ".join(items[2]).upper() + "!"), (3, " ".join(words(5) + near)), (4, " ".join(far)), (5, " ".join(items[3])), (6, "x " + " ".join(items[4]) + " y"), (7, " ".join(words(300))), (8, None), (9, ""), (10, " ".join(items[0][:30])), (1, "again")]
    table = spark.createDataFrame([(*t, "a", 1) for t in texts], "doc_id long, text string, item_id string, hit int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}

    def bag(w):
        w = [x.lower().strip(":,!") for x in w]
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    want = set()
    for i, t in texts:
        w = (t or "").split()
        for k, item in enumerate(items):
            size = min(len(item), len(w))
            for p in range(len(w) - size + 1) if size >= min(5, len(item)) else ():
                a, b = bag(item), bag(w[p : p + size])
                if size and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.add((i, k))
    assert got == want and {(1, 0), (2, 2), (3, 5), (5, 3), (6, 4)} <= got and 4 not in {i for i, _ in got}
    clean = decontaminate.without_items(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.where("text is null or text <> 'again'").collect()} == {4, 7, 8, 9, 10}
    assert decontaminate.contaminated(none, bench).collect() == [] and decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    """A benchmark of several blocks finds what one block finds; each block is written before the next."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [words(20) for _ in range(9)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    texts = [(k, " ".join(words(30) + items[k % 9] + words(5))) for k in range(9)] + [(20, " ".join(words(80))), (21, " ".join(words(70_000) + items[4])), (None, " ".join(items[1])), (3, None)]
    table = spark.createDataFrame(texts * 2, "doc_id long, text string")
    one = sorted(map(tuple, decontaminate.contaminated(table, bench).collect()), key=repr)
    clean = sorted(map(tuple, decontaminate.without_items(table, bench).collect()), key=repr)
    assert {x[:2] for x in one} == {(k, k) for k in range(9)} | {(21, 4), (None, 1)} and len(one) == 22 and {r[0] for r in clean} == {20, 3} and len(clean) == 4
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_WORDS", 45)
    assert [len(items) for items, _ in decontaminate.item_blocks(bench)] == [2, 2, 2, 2, 1]
    assert sorted(map(tuple, decontaminate.contaminated(table, bench).collect()), key=repr) == one
    assert sorted(map(tuple, decontaminate.without_items(table, bench).collect()), key=repr) == clean


def test_every_fingerprint_within_the_radius_is_found():
    rng = random.Random(4)
    index = decontaminate.ItemIndex([(k, " ".join(f"a{rng.randrange(99)}" for _ in range(12))) for k in range(50)])
    for k in range(50):
        for distance in (0, 5, 16, decontaminate.RADIUS):
            fp = index.prints[k]
            for bit in rng.sample(range(64), distance):
                fp ^= 1 << bit
            assert k in index.near(12, fp)


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    calm = [f"calm{k}" for k in range(300)]
    bad = ["vile", "foul", "rotten"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        w = [rng.choice(calm) for _ in range(rng.randrange(10, 60))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + f"{rng.choice('abcdefgh')}x")
        rows.append((k, " ".join(w), "en" if k % 2 else "de"))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, marks)
    got = {r.doc_id: r for r in toxicity.toxicity(table, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in got if got[k].held_out] == [k for k in got if k in set(held)]
    right = sum(got[k].predicted == dict(labels)[k] for k in held) / len(held)
    assert right > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == len(corpus()) and len({r.score for r in odd if r.doc_id in (2, 3, 10)}) == 1
    other = toxicity.train(table.withColumn("lang", F.lit(None).cast("string")), marks)
    assert np.array_equal(model.table, other.table)
    assert toxicity.toxicity(none, model).collect() == [] and toxicity.train(none, marks).score(toxicity.rows_of(["x"])[0]) < 0.01
    assert toxicity.without_toxic(table, model).columns == table.columns


def test_toxicity_is_calibrated_outside_the_sample(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(2400):
        toxic = rng.random() < 0.1
        w = [f"calm{rng.randrange(200)}" for _ in range(12)]
        if rng.random() < (0.7 if toxic else 0.1):
            w.insert(rng.randrange(len(w)), "vile")
        rows.append((k, " ".join(w), "en" if k % 2 else "de"))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"), {1: 60, 0: 60})
    scores = [r.score for r in toxicity.toxicity(table, model).collect()]
    # the sample is half toxic, the table a tenth; a fifth of the sample has too few toxic rows for thresholds
    assert abs(sum(scores) / len(scores) - sum(y for _, y in labels) / len(labels)) < 0.03
    assert set(model.thresholds) == {"en", "de"} and all(t != toxicity.THRESHOLD for t in model.thresholds.values())


def brute_logit(model, ids):
    """The convolution written out: every window, filter and place of its own."""
    over, at, best = max(toxicity.WIDTHS) - 1, 0, []
    rows = [sum(model.table[w].astype(float) for w in word) for word in ids]
    if len(ids) == over:
        return model.constant
    for k in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best.append(max(sum(rows[p + o][at + o * toxicity.FILTERS + f] for o in range(k)) for p in range(len(rows) - k + 1)))
        at += k * toxicity.FILTERS
    return model.constant + sum(max(0.0, x + b) * w for x, b, w in zip(best, model.bias, model.weights, strict=True))


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(2)
    columns = sum(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS, columns)).astype(np.float32), rng.normal(0, 0.2, 24), rng.normal(0, 1, 24), 0.25)
    model.table[0] = 0
    texts = ["", None, "one", "one two", "Gone, gone; gone!", " ".join(f"w{k % 50}" for k in range(400)), "é " * 30]
    for ids in toxicity.rows_of(texts):
        assert abs(model.logit(ids) - brute_logit(model, ids)) < 1e-4
    # longer than the stretches that are worked off together
    (ids,) = toxicity.rows_of([" ".join(f"w{k}" for k in range(40_000))])
    assert abs(model.logit(ids) - brute_logit(model, ids)) < 1e-3


def test_toxicity_sample_is_bounded_also_where_rows_repeat(spark):
    rows = [(k, ("vile " if k % 4 == 0 else "calm ") * 20, "en") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    repeated = spark.createDataFrame([r for r in rows for _ in range(3)] + [(4, "vile " * 50_000, "en")], "doc_id long, text string, lang string")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda train: seen.append(train) or fit(train)
        model = toxicity.train(repeated, labels, {1: 20, 0: 20}, sample_chars=2000)
        toxicity.train(repeated, labels, {1: 20, 0: 20})
    finally:
        toxicity.fit = fit
    assert sum(len(ids) - 2 for ids, _ in seen[0]) <= 400 and len(seen[1]) <= 40
    assert len(toxicity.toxicity(repeated, model).collect()) == 601
    clash = spark.createDataFrame([(1, "calm", "en", 1, 2), (1, "calm", "en", 1, 2), (None, None, None, None, None)], "doc_id long, text string, lang string, score int, h int")
    out = toxicity.without_toxic(clash, model)
    assert out.columns == clash.columns and out.count() == 3 and toxicity.without_toxic(clash.limit(0), model).count() == 0


def test_toxicity_calibration_counts_every_row_outside_the_fit(spark, monkeypatch):
    rows = [(k, "vile word" if k % 8 == 0 else "calm word", "en") for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(400)], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "calibrate", lambda model, cells, fitted: seen.update(cells=cells, fitted=fitted))
    toxicity.train(table, labels, {1: 5, 0: 20})
    usable = Counter(int(k % 8 == 0) for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2)
    left = Counter()
    for toxic, _, _, n in seen["cells"]:
        left[toxic] += n
    assert seen["fitted"] == {1: 5, 0: 20} and left + Counter(seen["fitted"]) == usable
