"""The operators against brute force, round trips and held-out labels, and on awkward rows."""

import collections
import hashlib
import random
import re
import struct
import sys
import zlib

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
from conftest import DATA, duck, same  # noqa: E402

from evidentia.llm import (  # noqa: E402
    chat_format, decontamination, gif_media, jaccard_join, language_id, license_scan, line_dedup, piece_bpe, queries, secrets, toxicity,
)

SMALL, MIDDLE = f"{DATA}/sf0.001", f"{DATA}/sf0.01"
LONG = "word " * 60_000
AWKWARD = [
    (1, None, "x"), (2, "", None), (3, " \n\t ", "x"), (4, "Same line here\nother line", "x"), (4, "Same line here\nother line", "x"),
    (5, "Same line here\nSame LINE here \nshort", "y"), (None, "Same line here", "z"), (6, LONG, "x"), (7, LONG + "end", "x"), (8, "日本語 🎉 \x00", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, 1, 2) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, __ev_id long")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(queries.SQL[name]).df())


# -- secrets -----------------------------------------------------------------


def brute_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_base_forms():
    r = random.Random(4)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "=", ":", " ", '"', "'", "é", "zz", "deadbeefdeadbeefdeadbeef", "ſecret"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [(s.kind, s.start, s.end) for s in secrets.base_spans(text)] == brute_base(text)


def test_secret_novelty():
    n = secrets.Novelty()
    key = "aZ3kQ9xV7bT2mW8pL4sR"
    assert [s.kind for s in secrets.novel_spans(f"the private key is {key} in prose", n)] == ["novel"]
    assert [s.kind for s in secrets.novel_spans("the private key is hQwPzkVbXmTgRyLdJcNf in prose", n)] == ["novel"]  # letters alone
    assert [s.kind for s in secrets.novel_spans("credential 83920175640298315577 in prose", n)] == ["novel"]  # digits alone
    assert secrets.novel_spans("the private key is abcdefghijklmnopqrstuvwxyz0123456789 here", n) == []
    assert secrets.novel_spans(f"{key} is used; the private value {key} again", n) == []  # a repeat is cheap
    assert secrets.novel_spans(f"nothing of note {key}", n) == []


def test_secret_dictionary_decides(spark):
    """The same token is novel under a dictionary that lacks it and cheap under one that has it."""
    names = ["quizzicalJackdawVortexHandler", "wrymouthed_zephyr_klaxon_gizmo", "fjordbankGlyphsVextQuiz", "Kwyjibo-Zugzwang-Flummoxed"]
    texts = [f"class {a} calls {b} and {c}" for a in names for b in names for c in names]
    rows = docs(spark, list(enumerate(texts)) + [(999, "the private key 9fK2xQ7mLz0PaT4vWc8RbY1n, the secret Onlyoncehereword"), (1000, None)])
    mined = secrets.mine_identifiers(rows)
    assert set(mined.decode().split()) == set(names)  # nothing with digits, nothing that one document has
    without, primed = secrets.Novelty(b"0123456789"), secrets.Novelty(mined + b"\n" + secrets.IDENTIFIERS)
    changed = 0
    for name in names:
        text = f"credential {name} in use"
        changed += bool(secrets.novel_spans(text, without)) and not secrets.novel_spans(text, primed)
        assert not secrets.novel_spans(text, primed)
    assert changed >= 2
    assert len(secrets.mine_identifiers(rows, most=40)) <= 40 and secrets.mine_identifiers(rows.limit(0)) == b""
    got = {r.doc_id: r.secrets for r in secrets.scan_secrets(rows).collect()}
    assert [x.kind for x in got[999]] == ["novel"] and not any(got[k] for k in range(64))


def test_secret_copies_stay_secret(spark):
    """A key of letters alone isn't taken for an identifier because copies of its text hold it."""
    key, name = "qhwzkvxmtgrypldjcnfbsoeauik", "quizzicalJackdawVortexHandler"
    text = f"the passphrase is {key} and the handler {name}"
    rows = docs(spark, [(1, text), (2, text), (3, text + " again"), (4, f"token token: {key}"), (5, "only here onlyInCopiesOfThisText"), (6, "only here onlyInCopiesOfThisText")] + [(10 + k, f"text {k} calls {name}") for k in range(8)])
    assert secrets.mine_identifiers(rows).decode().split() == [name]
    got = {r.doc_id: r.secrets for r in secrets.scan_secrets(rows).collect()}
    assert all(any(s.kind == "novel" and s.start == 18 for s in got[k]) for k in (1, 2, 3))


def test_secret_keys_and_names():
    """Planted keys outside the fixed forms are found, names of code aren't."""
    import string

    r, n = random.Random(7), secrets.Novelty()
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(20, 48))) for _ in range(300)]
    found = sum(any(s.start == 27 for s in secrets.novel_spans(f"passphrase of the service: {k} and then", n)) for k in keys)
    assert found >= 0.95 * len(keys)
    keys = ["".join(r.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(300)]
    assert sum(any(s.start == 27 for s in secrets.novel_spans(f"passphrase of the service: {k} and then", n)) for k in keys) >= 0.99 * len(keys)
    assert secrets.novel_spans("passphrase of the service: ABCDEF0123456789ABCDEF0123456789 and then", n) == []
    for name in ("application/json-application", "connection_database_server", "java/util/ArrayList/getInstance", "created_at_updated_at_deleted", "addEventListenerQuerySelector"):
        assert secrets.novel_spans(f"passphrase of the service: {name} and then", n) == []


def test_secret_novelty_of_unquoted_values():
    n = secrets.Novelty()
    key = "9fK2xQ7mLz0PaT4vWc8RbY1n"
    for head in ("private_key=", "PASSPHRASE=", "https://x.org/a?signature=", "client_id=", "aws_access_key_id=", "a=1&authorization=", "credential_2=", "private_key==", "[db]\ncredential="):
        for tail in ("", "==", "\n", "&x=1", " and more"):
            text = head + key + tail
            end = len(head + key) + 2 * (tail == "==")
            assert secrets.novel_spans(text, n) == [("novel", len(head), end)], text
    name = "the credential is in configuration_parameter_description="
    assert secrets.novel_spans(name + key, n)[-1].end == len(name + key)
    assert [s.end for s in secrets.novel_spans(f"private_key=aZ3kQ9xV7b=T2mW8pL4sR client_id={key}", n)] == [33, 44 + len(key)]
    assert secrets.novel_spans("private_key=abcdefghijklmnopqrstuvwxyz0123456789", n) == []
    assert secrets.novel_spans(f"private_key={key * 40}", n) == []  # beyond the window, and repeats
    assert secrets.novel_spans("secret1=" * 20_000, n) == []


def test_secret_rows(spark, odd, none):
    assert secrets.scan_secrets(odd).count() == len(AWKWARD)
    assert secrets.scan_secrets(none).count() == 0
    got = queries.QUERIES["op1_secret_scan"](spark, SMALL).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in got:
        want = brute_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert all(f"{k}:{a}:{b}" in r.spans for k, a, b in want)


# -- decontamination ---------------------------------------------------------


def test_decontamination_blocks_and_bounds(spark):
    r = random.Random(1)
    item = [f"w{r.randint(0, 30)}" for _ in range(40)]
    bench = spark.createDataFrame([(10, " ".join(item)), (9, "only three words"), (8, ""), (7, None), (9, "only three words")], "item_id long, text string")
    rows = [(1, "a " + " ".join(item[5:18]) + " b"), (2, " ".join(item[5:17])), (3, "x ONLY-three.words y"), (4, "only three"), (5, None), (6, " ".join(item)), (6, " ".join(item))]
    one = decontamination.decontaminate(docs(spark, rows), bench).orderBy("doc_id").collect()
    many = decontamination.decontaminate(docs(spark, rows), bench, block_words=5).orderBy("doc_id").collect()
    assert [tuple(x) for x in one] == [tuple(x) for x in many]
    assert [(x.doc_id, x.n_hit, x.item_ids) for x in one] == [(1, 13, ["10"]), (2, 0, []), (3, 3, ["9"]), (4, 0, []), (5, 0, []), (6, 40, ["10"]), (6, 40, ["10"])]
    assert [x.contaminated for x in one] == [True, False, True, False, False, True, True]


def test_decontamination_of_repeated_words():
    """Many windows under one prefix token cost a document no more than a few."""
    import time

    r = random.Random(6)
    items = [(str(k), " ".join(r.choice(["aa", "bb", "cc"]) for _ in range(40)).encode()) for k in range(200)]
    index = decontamination.WindowIndex(items, {})
    w = decontamination.words(b" ".join(r.choice([b"aa", b"bb", b"cc"]) for _ in range(1950)) + b" " + items[7][1])
    began = time.process_time()
    spans, found = index.hits(w)
    assert time.process_time() - began < 0.5
    every = {win: i for i, text in items for win in decontamination.item_windows(text)}
    want = {(p, p + 13) for p in range(len(w) - 12) if tuple(w[p : p + 13]) in every}
    assert set(spans) == want and "7" in found


def test_decontamination_rows(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.decontaminate(odd, bench)
    assert out.where("contaminated").count() == 0 and out.count() == len(AWKWARD) and "source" in out.columns
    assert decontamination.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_decontamination_null_ids(spark, tmp_path):
    for t in ("documents", "benchmark"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        if t == "benchmark":
            df = df.selectExpr("nullif(item_id, item_id - item_id % 2) AS item_id", "text")
            assert df.where("item_id IS NULL AND text IS NOT NULL").count()
        df.coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same(queries.QUERIES["op2_decontamination"](spark, str(tmp_path)).toPandas(), con.sql(queries.SQL["op2_decontamination"]).df())
    bench = spark.createDataFrame([(None, "one two"), (None, "three four"), (7, "two three")], "item_id long, text string")
    for size in (2, 2_000_000):
        got = decontamination.decontaminate(docs(spark, [(1, "one two three four"), (2, "x two three")]), bench, block_words=size).orderBy("doc_id").collect()
        assert [(g.n_hit, g.item_ids) for g in got] == [(4, ["7", None]), (2, ["7"])]


def test_decontamination_takes_one_worker(spark):
    """Python functions in a row each take a worker of their own for a core, and those live on."""
    bench = spark.createDataFrame([(1, "one two"), (2, "three four")], "item_id long, text string")
    d = spark.createDataFrame([(1, "one two three four", 5, 6)], "doc_id long, text string, spans int, extra int")
    for size, items in ((2, bench), (2_000_000, bench), (2, bench.limit(0))):
        out = decontamination.decontaminate(d, items, block_words=size)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert out.columns == ["doc_id", "text", "extra", "n_words", "n_hit", "item_ids", "spans", "contaminated"]
        assert out.first().n_hit == (4 if items is bench else 0)


# -- SentencePiece -----------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = piece_bpe.default_model()
    return piece_bpe.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(pieces):
    mine, lib = pieces
    r = random.Random(2)
    for k in range(3000):
        text = "".join(r.choice("ab the▁ \n\t\x00éñ日🎉▁<0x0A></s>aaaooth  ,.;́") for _ in range(r.randint(0, 40)))
        text = " " * r.randint(0, 40) * (k % 4 == 0) + text
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert mine.encode(text) == ids and mine.decode(ids) == lib.decode(ids) == mine.encode_decode(text)[1]


def test_decode_of_broken_bytes(pieces):
    mine, lib = pieces
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randint(0, 400) for _ in range(r.randint(0, 12))]
        assert mine.decode(ids) == lib.decode(ids), ids


def test_pieces_side_by_side(pieces, monkeypatch):
    """Only segments that are too long are encoded one by one; all others have their tables filled side by side."""
    mine, lib = pieces
    r = random.Random(5)
    gap = mine.gap
    texts = ["".join(r.choice(["th", "ion", "éa", "ß", "##", "$", ".!", ", ", " ", "  ", "▁", "\n", "日", "🎉", "1", gap, "²", "…"]) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "▁", gap, "a" * mine.LONGEST, "a" * (mine.LONGEST - 1), *("abcde" * 20, "x" * 500)]
    texts += [x or "" for x in pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()]
    alone = []
    tokens = type(mine).tokens
    monkeypatch.setattr(type(mine), "tokens", lambda self, text: alone.append(text) or tokens(self, text))
    monkeypatch.setattr(mine, "new", {})
    monkeypatch.setattr(mine, "old", {})
    got = mine.encode_all(texts)
    assert all(len(x) > mine.LONGEST for x in alone) and "a" * mine.LONGEST in "".join(alone)
    for text, (ids, decoded) in zip(texts, got, strict=True):
        want = lib.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and decoded == lib.decode(want), text
    assert got == mine.encode_all(texts) == [mine.encode_decode(x) for x in texts]  # from what is kept, and one by one
    monkeypatch.setattr(mine, "KEPT", 50)
    assert mine.encode_all(texts) == got and len(mine.new) <= 50


def test_pieces_tables_equal_one_by_one(pieces):
    mine, _ = pieces
    r = random.Random(6)
    segments = sorted({"".join(r.choice("  aehinorst.,#éß日\x00") for _ in range(r.randint(1, mine.LONGEST))) for _ in range(2000)}, key=lambda s: s[::-1])
    ids, stop = mine.tokens_of(segments)
    for s, a, b in zip(segments, [0, *stop], stop):
        assert ids[a:b].tolist() == mine.tokens(s), s


def test_pieces_rows(spark, odd, none, pieces):
    _, lib = pieces
    out = piece_bpe.encode_documents(odd, piece_bpe.default_model()).collect()
    for r in out:
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == ids and r.decoded == lib.decode(ids)
    assert piece_bpe.encode_documents(none, piece_bpe.default_model()).count() == 0
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_piece_bpe"](spark, SMALL).collect():
        ids = lib.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# -- language ----------------------------------------------------------------


def test_language_held_out(spark):
    got = queries.QUERIES["op4_language_id"](spark, MIDDLE).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_rows(spark, odd, none):
    model = language_id.train(docs(spark, []).selectExpr("doc_id", "text", "cast(null as string) as lang"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.predict_languages(odd, model).collect()} == {"und"}
    some = spark.createDataFrame([(k, ("the and of with " if k % 2 else "der die und mit ") * 5, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(some, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.predict_languages(docs(spark, [(1, "the and of"), (2, "und die mit der"), (3, None), (4, "123 !!"), (5, "")]), model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3].score == 0
    assert language_id.predict_languages(none, model).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 7, 12):
        code = language_id.codewords(n)
        assert len(code) == n and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 4


# -- line dedup --------------------------------------------------------------


def test_lines_rows(odd, none):
    out = line_dedup.dedup_lines(odd, batches=3, fan_in=2)
    rows = sorted(((r.doc_id or 99, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=lambda r: r[:2])
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    assert by[1] == by[2] == [(1, 0, "")] and by[4] == [(2, 0, "Same line here\nother line")] * 2
    assert by[5] == [(3, 2, "short")] and by[99] == [(1, 1, "")] and by[6][0][1] == 0
    assert set(out.columns) == {*odd.columns, "n_lines", "n_dropped", "kept_text"}
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_batches_agree(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    a, b = (sorted(map(tuple, line_dedup.dedup_lines(d, batches=n, fan_in=2).select("doc_id", "n_dropped", "kept_text").collect())) for n in (1, 5))
    assert a == b
    plan = line_dedup.dedup_lines(d)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- chat --------------------------------------------------------------------


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "[INST] a \\ </s> <\\"), (1, 0, "user", None), (2, 0, "assistant", "x"), (3, 0, None, "<s>"), (None, 0, "user", "q"), (4, 0, "tool [x]", "y"), (4, 0, "tool [x]", "y")]
    c = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(c)
    got = {r.conv_id: r for r in out.withColumn("turns", chat_format.read_turns(out["formatted"])).withColumn("loss", chat_format.loss_text(out["segments"])).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("assistant", rows[0][3])] and got[1].loss == rows[0][3] and got[1].valid and got[1].complete
    assert not got[2].valid and not got[3].valid and [tuple(t) for t in got[3].turns] == [("", "<s>")]
    assert [tuple(t) for t in got[4].turns] == [("tool [x]", "y")] * 2 and got[None].valid and not got[None].complete
    assert chat_format.format_chats(c.limit(0)).count() == 0


def test_chat_long_text(spark):
    text = "<[\\" * 40_000
    c = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(c)
    assert [t.text for t in out.select(chat_format.read_turns(out["formatted"]).alias("t")).first().t] == [text, text]


# -- toxicity ----------------------------------------------------------------


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_toxicity"](spark, f"{DATA}/sf0.1").collect()}
    labels = [r for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    toxic, clean = ([got[r.doc_id].predicted for r in labels if r.toxic == y] for y in (1, 0))
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, empty, "doc_id", "text", "toxic")
    assert {r.score for r in toxicity.score_toxicity(odd, model).collect()} == {0.0}
    assert toxicity.score_toxicity(none, model).count() == 0


def test_toxicity_risk():
    """The estimate against a plain one, its slopes against differences, and a step back where the negative part is below zero."""
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    for prior in (0.05, 0.4, 0.9):
        fp, fu = rng.normal(1, 2, 40), rng.normal(-1, 2, 90)
        plus = sum(math.log(1 + math.exp(-f)) for f in fp) / 40
        minus = sum(math.log(1 + math.exp(f)) for f in fu) / 90 - prior * sum(math.log(1 + math.exp(f)) for f in fp) / 40
        assert toxicity.risk(fp, fu, prior) == pytest.approx(prior * plus + max(0, minus))
        gp, gu = toxicity.slopes(fp, fu, prior)
        for g, f, sign in ((gp, fp, 0), (gu, fu, 1)):
            step = np.zeros_like(f)
            step[3] = 1e-5
            moved = (fp + step, fu) if not sign else (fp, fu + step)
            change = (toxicity.risk(*moved, prior) - toxicity.risk(fp, fu, prior)) / 1e-5
            back = -(toxicity.negative_part(*moved, prior) - toxicity.negative_part(fp, fu, prior)) / 1e-5
            assert g[3] == pytest.approx(change if minus >= 0 else back, abs=1e-4)
    fp, fu = np.full(20, 3.0), np.full(20, -3.0)  # positives alone are called toxic, less often in unlabelled texts than the prior says
    assert toxicity.negative_part(fp, fu, 0.5) < 0
    gp, gu = toxicity.slopes(fp, fu, 0.5)
    assert toxicity.negative_part(fp - 0.1 * gp, fu - 0.1 * gu, 0.5) > toxicity.negative_part(fp, fu, 0.5)


def test_toxicity_fit_and_threshold():
    import numpy as np

    def rows(docs):
        return toxicity.Rows([(np.array(sorted(set(d)), np.int32), np.array([d.count(x) for x in sorted(set(d))])) for d in docs], np.ones(1 << toxicity.BITS, bool))

    r = random.Random(3)
    toxic, clean = ([[r.choice(a) for _ in range(6)] for _ in range(n)] for a, n in (((1, 2, 3, 7), 60), ((4, 5, 6, 7), 240)))
    pos, unl = rows(toxic[:40]), rows(toxic[40:] + clean)
    w, b = toxicity.fit(pos, unl, 20 / 260)
    got = toxicity.risk(pos.dot(w) + b, unl.dot(w) + b, 20 / 260)
    for k in range(200):  # nothing near it, nor at random, is clearly better
        rng = np.random.default_rng(k)
        other = w.copy()
        other[1:8] = (0 if k % 2 else other[1:8]) + rng.normal(0, 1, 7)
        assert got <= toxicity.risk(pos.dot(other) + b, unl.dot(other) + b, 20 / 260) + 0.02
    cut = toxicity.threshold(pos.dot(w), unl.dot(w), 20 / 260)
    f = unl.dot(w)
    assert (f[:20] > cut).mean() >= 0.95 and (f[20:] > cut).mean() <= 0.01
    assert toxicity.threshold(np.array([5.0, 6.0]), np.array([0.0, 1.0, 5.5, 0.5]), 0.25) == pytest.approx(3.0)


def test_toxicity_awkward_rows_with_a_model(spark, odd):
    d = docs(spark, [(k, ("vile word here " if k < 40 else "fine words there ") * (1 + k % 3) + f"x{k} y{k * 7}") for k in range(200)])
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(100)] + [(None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, "doc_id", "text", "toxic")
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and {r.predicted for r in got if not r.text} == {0}
    seen = {r.doc_id: r for r in toxicity.score_toxicity(docs(spark, [(1, "so vile word here"), (2, "so fine"), (3, "vile " * 50_000)]), model).collect()}
    assert seen[1].predicted == seen[3].predicted == 1 and seen[2].predicted == 0


def test_toxicity_rarer_words(spark):
    """Words in few of the toxic texts tell even where more than 1,000 others tell more."""
    import numpy as np

    r = random.Random(12)
    strong, rows = [f"s{k}" for k in range(1200)], []
    for k in range(300):
        w = r.sample(strong, 300) + ([f"r{j}" for j in range(5)] if k % 25 == 0 else [])
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(f"c{r.randrange(500)}" for _ in range(20))) for k in range(300, 2300)]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, "doc_id", "text", "toxic")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs(spark, [(1, "r0 r1 r2 r3 r4"), (2, ""), (3, "c1 c2")]), model).collect()}
    assert got[1] > got[2] == got[3]
    want = np.zeros(1 << toxicity.BITS, int)
    for i, _ in toxicity.word_counts([t.encode() for _, t in rows]):
        want[i] += 1
    assert (toxicity.document_frequencies(d, "text") == want).all()


# -- Jaccard join ------------------------------------------------------------


def brute_components(rows, size, similar):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,similar", [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, similar):
    r = random.Random(size)
    rows, n = [], 0
    for _ in range(12):  # families whose members differ by about as much as is allowed
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([8, 12, 25, 60, 150]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            rows.append((n, " ".join(w[r.randint(0, 2) :])))
            n += 1
    rows += [(n, "Two words"), (n + 1, "two WORDS"), (n + 2, ""), (n + 3, None), (n + 4, rows[0][1])]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, rows), size=size, similar=similar, keep=["doc_id"]).collect()}
    assert got == brute_components(rows, size, similar)


def test_jaccard_ids_with_several_texts(spark):
    """1 and 2 link by one text, 2 and 3 by another whose distance to the pivot, 1, isn't what the least distance says."""
    base = [f"w{k}" for k in range(200)]
    near = ["y0" if k == 50 else "y1" if k == 150 else w for k, w in enumerate(base)]
    pivots = [[*near[:k], *(f"z{k}x{j}" for j in range(10)), *near[k + 10 :]] for k in range(0, 190, 10)]
    rows = [(1, " ".join(p)) for p in pivots] + [(2, " ".join(near)), (2, " ".join([*pivots[0][:-1], "end"])), (3, " ".join(base))]
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs(spark, rows), size=3, similar=90, keep=["doc_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_drop_linked_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = b.replace("b59", "end")
    rows = [(None, a, 1), (None, a, 2), (5, a, 3), (9, a, 4), (None, b, 5), (None, near, 6), (None, c, 7), (None, None, 8), (None, "", 9), (-3, c + " more", 10), (7, "x y", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(r.n for r in jaccard_join.drop_linked(df).collect())
    assert got in ([3, 5, 8, 9, 10, 11], [3, 6, 8, 9, 10, 11])


def test_linked_sets_share_a_site():
    """Texts at the edge of what links, whatever the counts of their words."""
    import numpy as np

    r = random.Random(9)
    rare = np.array([r.random() * r.choice([1, 9]) for _ in range(1 << jaccard_join.COUNTERS)], np.float32)
    linked = 0
    for size, similar in ((1, 80), (2, 90), (3, 80)):
        for _ in range(400):
            x = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(1, 200))]
            y = list(x)
            for _ in range(r.randint(0, len(x) // 12 + 1)):
                y[r.randrange(len(y))] = f"v{r.randint(0, 10**6)}"
            y = y[r.randint(0, 1 + len(y) // 20) :] or ["z"]
            texts = [" ".join(z).encode() for z in (x, y)]
            a, b = jaccard_join.shingle_sets(texts, size)
            o = jaccard_join.shingle_sets(texts, size, rare)
            assert [len(z) for z in o] == [len(a), len(b)] and all((z[1:] > z[:-1]).all() for z in o)
            if 100 * len(np.intersect1d(a, b)) >= similar * len(np.union1d(a, b)):
                linked += 1
                assert len(np.intersect1d(*(jaccard_join.sites(z, similar) for z in o)))
    assert linked > 300


def test_linked_sets_share_a_projection():
    import numpy as np

    r = random.Random(9)
    for similar in (80, 90):
        edges, known = jaccard_join.size_regions(similar), {}
        for _ in range(400):
            both = r.randint(1, 400)
            spare = (100 * both // similar) - both
            a = r.randint(0, spare)
            pool = np.array([r.getrandbits(64) for _ in range(both + spare)], np.uint64)
            x, y = np.unique(pool[: both + a]), np.unique(np.concatenate([pool[:both], pool[both + a :]]))
            kx, ky = (set(jaccard_join.projections(s, similar, edges, known).tolist()) for s in (x, y))
            assert kx & ky


def test_shingles_are_the_words():
    """Equal shingles for equal words and only for these, at any length and place of a word."""
    r = random.Random(3)
    alphabet = ["a", "B", "é", "\0", "日本", "x" * 7, "y" * 8, "z" * 9, "q" * 300, " ", "\n", "\t", "\x0b", "\x1c", " "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    for size in (1, 3):
        got = jaccard_join.shingle_sets([t.encode() for t in texts], size)
        meaning: dict[int, tuple] = {}
        for t, s in zip(texts, got):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            n = min(size, len(w))
            want = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            assert len(s) == len(want) and (s[1:] > s[:-1]).all()
            for k in want:
                h = int(jaccard_join.shingles(" ".join(k).encode(), size)[0])
                assert h in s and meaning.setdefault(h, k) == k


def test_sketches_bound_the_difference():
    import numpy as np

    r = random.Random(11)
    for n in (1, 5, 60, 400, 3000):
        for _ in range(40):
            x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            y = np.unique(np.concatenate([x[r.randint(0, n // 4) :], np.array([r.getrandbits(64) for _ in range(r.randint(0, n // 4))], np.uint64)]))
            bits = sum(int(b).bit_count() for b in (jaccard_join.sketch(x) ^ jaccard_join.sketch(y)).view(np.uint64))
            assert bits <= len(np.setxor1d(x, y)) and jaccard_join.overlap(x, y) == len(np.intersect1d(x, y))
            for a in (512, 1024, 2048):
                folded = jaccard_join.bits_apart(jaccard_join.sketch(x, a).tobytes(), jaccard_join.sketch(y, 1024).tobytes())
                assert bits <= folded <= len(np.setxor1d(x, y)) and (jaccard_join.wide_sketch(x) is None) == (len(x) <= 1024)


def test_jaccard_alike_cells_are_merged(spark):
    """Large cells of nearly the same members met as many sets of pivots as there were cells."""
    rows = [(key, i, 9, key == 1 or i % 2 == 0, i % 7, 0) for key in (1, 2, 3) for i in range(200 + key)]
    rows += [(4, i, 9, True, i % 7, 0) for i in range(1000, 1100)]
    got = jaccard_join._merged(spark.createDataFrame(rows, "key long, id long, n long, home boolean, c long, homes long")).collect()
    cells = {}
    for r in got:
        cells.setdefault(r.key, {})[r.id] = (r.home, r.homes)
    ids = {frozenset(c) for c in cells.values()}
    assert ids == {frozenset(range(203)), frozenset(range(1000, 1100))} and len(got) == 303
    assert all(homes == sum(h for h, _ in c.values()) for c in cells.values() for _, homes in c.values())
    assert all(c[i][0] for c in cells.values() for i in c if i < 201 or i == 202 or i >= 1000)


def test_jaccard_voronoi_cells(spark, monkeypatch):
    """Regions far larger than their pivots: sets that share a rare passage, at all distances."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 6)
    monkeypatch.setattr(jaccard_join, "CLOSE", 12)
    r = random.Random(21)
    shared = [f"p{k}" for k in range(12)]
    rows = []
    for k in range(150):
        own = [f"o{r.randint(0, 3)}x{j}" for j in range(r.choice([2, 4, 8, 12]))]
        rows.append((k, " ".join(shared[: r.randint(9, 12)] + own)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs(spark, rows), size=2, similar=80, keep=["doc_id"]).collect()}
    assert got == brute_components(rows, 2, 80)


def test_jaccard_query(spark, tmp_path):
    """The registered query's rows, over a table of whole texts."""
    rows = [r[:2] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op8_jaccard_join"](spark, SMALL)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and dict(got.dtypes) == {c: "bigint" for c in got.columns}
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components([tuple(r) for r in rows], 3, 90)


def test_jaccard_rows(odd, none):
    out = jaccard_join.jaccard_components(odd)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and set(out.columns) == {*odd.columns, "n_shingles", "component_id"}
    by = {r.doc_id: r.component_id for r in rows}
    assert by[7] == 7 and by[6] == 6 and by[1] == 1 and by[None] is None and by[4] == 4
    assert jaccard_join.jaccard_components(none).count() == 0


# -- licenses ----------------------------------------------------------------


def test_license_bands_lose_nothing(spark):
    index, r = license_scan.LicenseIndex(), random.Random(5)
    names = sorted(license_scan.TEMPLATES)
    for _ in range(300):
        parts = []
        for _ in range(r.randint(0, 3)):
            parts.append(" ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(0, 90))))
            w = license_scan.TEMPLATES[r.choice(names)].split()
            if r.random() < 0.4 and len(w) > 30:
                w[r.randrange(len(w))] = "changed"
            parts.append(" ".join(w))
        text = " ".join(parts).encode()
        assert index.matches(text) == index.matches(text, banded=False)
    for n in names:
        assert n in {m.license for m in index.matches(license_scan.TEMPLATES[n].encode())}


def test_license_short_templates_in_any_context():
    index, r = license_scan.LicenseIndex(), random.Random(8)
    short = [n for n, s in index.sets.items() if len(s) <= 4]
    assert {"MIT-short", "MIT-licensed", "CC-BY-4.0", "CC-BY-SA-4.0"} <= set(short)
    for k in range(6000):
        name = short[k % len(short)]
        before, after = (" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 40))) for _ in "ab")
        text = f"{before} {license_scan.TEMPLATES[name]} {after}".encode()
        assert [m.license for m in index.matches(text)] == [name], text
    for half, names in index.classes.items():
        for n in set(names) - index.direct[half]:
            size, least = len(index.sets[n]), -(-len(index.sets[n]) * 4 // 5)
            assert (1 - least / (2 * half + size - least)) ** len(index.seeds[half]) <= 1e-6


def test_license_rows(odd, none):
    assert license_scan.scan_licenses(odd).where("size(licenses) > 0").count() == 0
    assert license_scan.scan_licenses(none).count() == 0


def test_license_query(spark):
    """The registered query's rows against every template in every window."""
    index = license_scan.LicenseIndex()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op9_license_scan"](spark, MIDDLE)
    assert got.columns == ["doc_id", "n_licenses", "license_ids", "spans", "best_contained"]
    rows = got.collect()
    assert len(rows) == len(text) and sum(r.n_licenses > 0 for r in rows) > 0
    for r in rows:
        want = index.matches((text[r.doc_id] or "").encode(), banded=False)
        assert r.n_licenses == len(want) and r.spans == ",".join(f"{m.license}:{m.start}:{m.end}" for m in want)
        assert r.license_ids == ",".join(sorted({m.license for m in want})) and r.best_contained == max((m.contained for m in want), default=0.0)


# -- GIF ---------------------------------------------------------------------


def plain_gif_levels(data):
    """The samples of all frames, by a decoder that shares nothing with the operator's."""
    assert data[:6] == b"GIF89a" and data[10] & 0x80
    at, out = 13 + 3 * 2 ** ((data[10] & 7) + 1), []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            assert data[at] == 0x2C and not data[at + 9] & 0xC0
            least = data[at + 10]
            at += 11
            body, k = b"", at
            while data[k]:
                body += data[k + 1 : k + 1 + data[k]]
                k += data[k] + 1
            bits = "".join(f"{b:08b}"[::-1] for b in body)
            words, size, pos, before = {}, least + 1, 0, None
            while True:
                code, pos = int(bits[pos : pos + size][::-1], 2), pos + size
                if code == 1 << least:
                    words, size, before = {k: bytes([k]) for k in range(1 << least)}, least + 1, None
                    free = (1 << least) + 2
                    continue
                if code == (1 << least) + 1:
                    break
                word = words[code] if code in words else before + before[:1]
                out.append(word)
                if before is not None and free < 4096:
                    words[free] = before + word[:1]
                    free += 1
                    size = min(12, max(size, free.bit_length()))
                before = word
            at = k + 1
            continue
        while data[at]:
            at += data[at] + 1
        at += 1
    return b"".join(out)


def test_gif_against_a_plain_decoder():
    r = random.Random(16)
    for k in range(40):
        p = gif_media.padded(bytes(r.choice(b"abc") if k % 2 else r.randrange(256) for _ in range(r.choice([0, 1, 64, 300, 7000]))))
        for small in (False, True):
            assert plain_gif_levels(gif_media.encode_bytes(p, small=small)) == p


def test_gif_query(spark):
    """The registered query's rows, with the media decoded by the plain decoder."""
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op10_gif_media"](spark, SMALL)
    assert got.columns[:7] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    rows = got.collect()
    assert len(rows) == len(text)
    for k, r in enumerate(rows):
        payload = text[r.doc_id] + bytes(-len(text[r.doc_id]) % 64 or (0 if text[r.doc_id] else 64))
        media = gif_media.encode_bytes(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        if k % 20 == 0:
            assert plain_gif_levels(media) == payload


def test_gif_round_trips():
    r = random.Random(6)
    for k in range(120):
        data = bytes(r.choice(b"ab") if k % 2 else r.randrange(256) for _ in range(r.choice([0, 1, 63, 64, 65, 5000])))
        p = gif_media.padded(data)
        assert len(p) % 64 == 0 and len(p) > 0 and p.rstrip(b"\0") == data.rstrip(b"\0")
        for small in (False, True):
            assert gif_media.read_back(gif_media.encode_bytes(p, small=small))[0] == p
    big = bytes(range(256)) * 16_384
    assert gif_media.read_back(gif_media.encode_bytes(big))[0] == big  # two frames


def gif(frames, size=(4, 4), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(c for p in palette for c in p)]
    for x, y, w, h, levels, disposal, clear, delay, inter in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 * inter) + b"\x02" + gif_media._blocks(gif_media.lzw_encode(bytes(levels), 2)))
    return b"".join(out) + b";"


def test_gif_disposal_transparency_interlace():
    frames = [(0, 0, 4, 4, [1] * 16, 1, None, 5, 0), (1, 1, 2, 2, [2, 3, 3, 2], 3, 3, 7, 0), (0, 0, 1, 1, [3], 2, None, 1, 0), (3, 3, 1, 1, [2], 1, None, 0, 0)]
    got = list(gif_media.decode_frames(gif(frames)))
    assert [(f.start_ms, f.delay_ms) for f in got] == [(0, 50), (50, 70), (120, 10), (130, 0)]
    assert got[1].rgb[1, 1].tolist() == [0, 255, 0] and got[1].rgb[1, 2].tolist() == [255, 0, 0]  # transparent
    assert got[2].rgb[1, 1].tolist() == [255, 0, 0] and got[2].rgb[0, 0].tolist() == [0, 0, 255]  # put back
    assert got[3].rgb[0, 0].tolist() == [0, 0, 0]  # cleared
    rows = [1, 3, 2, 3, 0, 0, 0, 0]  # of 8 rows, stored in the order 0 4 2 6 1 3 5 7
    shown = list(gif_media.decode_frames(gif([(0, 0, 1, 8, rows, 0, None, 0, 1)], (1, 8))))[0].levels[:, 0].tolist()
    assert [shown[k] for k in (0, 4, 2, 6, 1, 3, 5, 7)] == rows


def test_gif_column(spark):
    good = gif([(0, 0, 4, 4, [1] * 16, 1, None, 5, 0)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(good[:-8])), (4, bytearray(b"junk")), (5, bytearray(b""))], "id long, media binary")
    rows = {r.id: r for r in gif_media.decode_column(df, "media").collect()}
    assert rows[1].frames[0].histogram[4] == 16 and rows[1].media_error is None and rows[2].frames == []
    assert rows[3].media_error and rows[4].media_error == "not a GIF" and rows[5].media_error


def test_gif_rows(odd, none):
    stored = gif_media.store_texts(odd).collect()
    for r in stored:
        assert gif_media.read_back(bytes(r.media))[0] == gif_media.padded((r.text or "").encode())
    assert gif_media.store_texts(none).count() == 0
