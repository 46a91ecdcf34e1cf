import json
import random
import unicodedata

from pyspark.sql import functions as F

from strataform.llm import copies, lookalike, queries, tokens


# ---- look-alikes ------------------------------------------------------------------------------------------------

ODD = ["6 М", "２ M", "0.5 M", "6​M", "gesättigt", "K2GdO4".replace("K", "K"), "mοl", "𝟤 M", "Ꮇ", "ɡ", "100-Ꮇօ"]
PLAIN = ["6 M", "¹⁸⁸Re", "CdCl₃·6H₂O", "α-Rb2O3", "β emitter 55Mn", "4–6 M", "5×10^-3 M", "saturée à 20 °C", "gesättigt", "", "   ", "≥ 5 M"]


def test_lookalikes(spark):
    rows = [(i, v) for i, v in enumerate([*ODD, *PLAIN, None, "x" * 100_000 + "​"])]
    df = spark.createDataFrame(rows, "item_id long, v string").withColumn("form", F.lit("clash")).withColumn("odd", F.lit(1))
    got = {r.item_id: r for r in lookalike.unify(df, "v", ["item_id"]).collect()}
    for i, v in rows:
        assert got[i].odd == (v is not None and i < len(ODD) or i == len(rows) - 1), v
        assert got[i].form == lookalike.unify_local(v)
    assert got[0].form == "6 M" and got[4].form == "gesättigt" and got[len(rows) - 1].form == "x" * 100_000
    f = lookalike.found([(df.unionByName(df), "v", "v")]).collect()
    assert sorted(r.item_id for r in f) == [*range(len(ODD)), len(rows) - 1]
    assert lookalike.found([(df.limit(0), "v", "v")]).count() == 0


def test_characters_that_stand_for_several(spark):
    want = {"5 ㎖": "5 ml", "20 ℃": "20 °C", "½ M": "1/2 M", "ﬁltered": "filtered", "Ⅻ": "XII", "⑴": "(1)", "3 ㎟": "3 mm2", "8 ㎛": "8 μm", "ﬃ": "ffi", "㏖": "mol", "Ⅳ": "IV", "ŉ": "ʼn", "１２": "12"}
    df = spark.createDataFrame(list(enumerate(want)), "item_id long, v string")
    got = {r.item_id: (r.form, r.odd) for r in lookalike.unify(df, "v", ["item_id"]).collect()}
    for i, (v, form) in enumerate(want.items()):
        if v != "ŉ":
            assert got[i] == (form, True), v
        assert got[i][0] == lookalike.unify_local(v)
    # every compatibility form of these blocks that is written in ordinary characters comes out so, and is reported
    blocks = [chr(c) for a, b in ((0x2100, 0x2150), (0x3371, 0x3400), (0xFB00, 0xFB07)) for c in range(a, b)]
    df = spark.createDataFrame(list(enumerate(blocks)), "item_id long, v string")
    for r in lookalike.unify(df, "v", ["item_id"]).collect():
        n = unicodedata.normalize("NFKC", blocks[r.item_id])
        if n.isascii() and n != blocks[r.item_id]:
            assert (r.form, r.odd) == (n, True)


def test_forms_of_all_three_fields(spark, tmp_path):
    spark.createDataFrame([(1, "6\u200b M"), (2, "6 M"), (2, "6 M")], "item_id long, concentration string").write.parquet(str(tmp_path / "acids_and_solvents.parquet"))
    spark.createDataFrame([(1, "⁶⁴Ni", "Ni\u200b"), (3, None, "NiO")], "item_id long, isotope string, chemical_formula string").write.parquet(str(tmp_path / "target_materials.parquet"))
    got = sorted((r.field, r.item_id, r.form, r.odd) for r in queries.p3_forms(spark, str(tmp_path)).collect())
    assert got == [("chemical_formula", 1, "Ni", True), ("chemical_formula", 3, "NiO", False), ("concentration", 1, "6 M", True), ("concentration", 2, "6 M", False), ("isotope", 1, "⁶⁴Ni", False), ("isotope", 3, None, False)]


# ---- copies -----------------------------------------------------------------------------------------------------


def test_copies(spark):
    a = {"name": "Hydrochloric acid", "concentration": "0.5 M", "role": None}
    rows = [
        (1, 1, "s", json.dumps(a)), (2, 1, "s", "CONCENTRATION=0.5-M; Name=hydrochloric  acid,;role="), (3, 1, "s", "name: [hydrochloric-acid] | concentration: '0.5 m' | role: "), (4, 1, "s", json.dumps(a | {"concentration": "5 M"})),
        (5, 2, "s", json.dumps(a)), (6, 1, "t", json.dumps(a)), (7, 1, "s", None), (8, 1, "s", ""), (9, None, "s", "x"), (10, None, "s", "X!"), (11, 1, "s", "not json {"), (12, 1, "s", "Not JSON"),
        (13, 1, "s", json.dumps({"v": "y" * 200_000})), (14, 1, "s", "V= " + "Y" * 200_000), (15, 1, "s", json.dumps({"a": "b", "c": "d"})), (16, 1, "s", json.dumps({"a": "d", "c": "b"})),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "raw_id long, paper_id long, section string, payload string, id int, h1 int")
    got = {(r.first_id, r.copy_id) for r in copies.copies(df, "raw_id", ["paper_id", "section"], "payload").collect()}
    assert got == {(1, 2), (1, 3), (7, 8), (9, 10), (11, 12), (13, 14)}
    assert copies.copies(df.limit(0), "raw_id", ["paper_id", "section"], "payload").count() == 0
    n = {r.first_id: r.n_copies for r in copies.collapsed(df, "raw_id", ["paper_id", "section"], "payload").collect()}
    assert n[1] == 3 and n[4] == 1 and sum(n.values()) == len(rows)


def test_repeated_names(spark, monkeypatch):
    rows = [(1, '{"role": "a", "Role": "b"}'), (2, "role=b;ROLE=a"), (3, "HCl; 6 M"), (4, "6-M; HCl"), (5, "role=a; role=a"), (6, "role=a"), (7, '{"role": "a", "role": "b"}'), (8, None)]
    df = spark.createDataFrame([(i, p, 1, "s") for i, p in rows], "raw_id long, payload string, paper_id int, section string")
    want = [(1, 3, [("role", "a"), ("role", "b")]), (3, 2, [("", "6m"), ("", "hcl")]), (5, 1, [("role", "a"), ("role", "a")]), (6, 1, [("role", "a")]), (8, 1, [])]
    run = lambda: sorted((r.first_id, r.n_copies, sorted(map(tuple, r.fields))) for r in copies.collapsed(df, "raw_id", ["paper_id", "section"], "payload").collect())
    assert run() == want
    monkeypatch.setattr(copies, "multiset_hash", lambda pairs, seed: F.lit(seed).cast("bigint"))  # all fingerprints meet
    assert run() == want


def test_hash_is_commutative_and_checked(spark):
    df = spark.createDataFrame([(["a1", "b2"], ["b2", "a1"], ["a1", "a1", "b2"], ["a1", "b2", "b2"], ["b2", "a1", "b2"])], "x array<string>, y array<string>, z array<string>, v array<string>, w array<string>")
    h = df.select(*[copies.multiset_hash(F.col(c), 1) for c in "xyz"], copies.same_multiset("x", "y"), copies.same_multiset("x", "z"), copies.same_multiset("z", "v"), copies.same_multiset("v", "w")).first()
    assert h[0] == h[1] != h[2] and h[3] and not h[4] and not h[5] and h[6]


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS raw_id", "CASE WHEN id % 3 = 0 THEN '{\"n\": \"A b\"}' ELSE concat('n=', id) END AS payload", "1 AS paper_id", "'s' AS section")
    assert copies.copies(df, "raw_id", ["paper_id", "section"], "payload").where("first_id = 0").count() == 999


# ---- tokens -----------------------------------------------------------------------------------------------------

ODD_TEXTS = ["", "a" * 3000, "   \n\n  x ", "<|endoftext|> is text", "é😀" * 30, "​﻿", " ", "x" * 70 + " y", "1234567 890", "can't WE'LL we'll"]


def test_tokens_match_the_merges(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.DEFAULT_RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    r = random.Random(3)
    words = ["the", " of", "\n", "  ", "Säure", "10.5", "über", "-", "№", "qzx", "\t", "é"]
    texts = ODD_TEXTS + ["".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(200)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(999, None)]
    got = {x.doc_id: x.ids for x in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    for i, x in enumerate(texts):
        assert got[i] == t.encode(x, add_special_tokens=False).ids, x
        assert t.decode(got[i], skip_special_tokens=False) == x or "�" in t.decode(got[i])
    assert got[999] == []
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_edits_equal_a_fresh_encoding():
    e = tokens.encoder(tokens.DEFAULT_RANKS)
    r = random.Random(5)
    base = "Subsequently the column was washed with 20 mL of 0.5 M acid.  Then\n\nnothing happened, can't it?"
    for _ in range(150):
        x = tokens.EncodedText(e, base)
        for _ in range(4):
            a = r.randrange(len(x.text) + 1)
            x.splice(a, min(len(x.text), a + r.randrange(5)), r.choice(["", "x", " the ", "\n", "é", "12", "   ", "'s"]))
            assert x.ids() == e.encode(x.text)
        x.append(" and more")
        assert x.ids() == e.encode(x.text)
