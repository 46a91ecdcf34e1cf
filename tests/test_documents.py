import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.operators import chat, extract, retrieve, segment


def sections(spark, text, **kw):
    df = spark.createDataFrame([(1, text, "clash")], "doc_id int, t string, line string")
    return [(r.section, r.page_content) for r in segment.sections(segment.lines(df, "doc_id", "t"), **kw).orderBy("seg").collect()]


def test_segments(spark):
    assert sections(spark, "Title\n1. Introduction\na\n\nb") == [("Front Matter", "Title"), ("1. Introduction", "a\nb")]
    assert sections(spark, "METHODS\n2.1. Target\nx") == [("2.1. Target", "x")]
    assert sections(spark, "Results show that\ny") == [("Results show that", "y")]
    assert sections(spark, "ABC\nz") == [("Front Matter", "ABC\nz")]
    assert sections(spark, "1 Introduction\nz") == [("Front Matter", "1 Introduction\nz")]
    assert sections(spark, "  \n ") == []
    assert sections(spark, "HEAD 1\n\nbody", upper=True, default="Unknown") == [("HEAD 1", "\nbody")]


def test_procedure(spark):
    df = spark.createDataFrame([("A b. Then c d.\n\nx",), (None,)], "t string")
    rows = [r[0] for r in df.select(segment.procedural_parts(F.col("t"))).collect()]
    assert rows[0] == ["A b.", "Then c d."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=30), max_size=20))
def test_splitter(parts):
    text = "\n".join(parts)
    out = segment.split_recursively(text, 40, 10)
    assert all(0 < len(x) <= 40 for x in out)
    for w in text.split():
        if len(w) <= 40:
            assert any(w in x for x in out)


def test_chunks(spark):
    text = "Front matter words here.\n1. Introduction\n" + " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    c = segment.chunks(segment.sections(segment.lines(df, "doc_id", "t"))).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in c] == list(range(len(c))) and all(len(r.page_content) <= 600 for r in c) and len(c) > 4


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, v array<float>").repartition(4)
    got = retrieve.nearest(df.where("id % 20 = 0").withColumnRenamed("id", "q"), df, "q", "v", "id", "v", k=3, block=2).collect()
    y = x.astype(np.float32).astype(float)
    for q in (0, 20, 40):
        want = sorted(range(60), key=lambda i: (((y[q] - y[i]) ** 2).sum(), i))[:3]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want


def msgs(spark, *rows):
    return spark.createDataFrame([("c", i, r, t) for i, (r, t) in enumerate(rows)], "conv_id string, turn int, role string, text string")


def out(df):
    return [(r.role, r.text) for r in df.orderBy("turn").collect()]


def test_chat(spark):
    m = msgs(spark, ("system", "s1"), ("system", "s2"), ("user", "u1"), ("user", "u2"), ("user", "u3"), ("assistant", "a1"), ("assistant", "a2"), ("system", ""), ("assistant", "a3"))
    assert out(chat.fold_system(m)) == [("user", "s1\n\ns2\n\nu1"), ("user", "u2\n\nu3"), ("assistant", "a1"), ("assistant", "a2"), ("user", " "), ("assistant", "a3")]
    assert out(chat.fold_system(msgs(spark, ("system", "only")))) == [("system", "only")]
    assert [r.text for r in chat.last_user(m).collect()] == ["u3"]
    assert [r.text for r in chat.last_user(msgs(spark, ("assistant", "x"))).collect()] == [" "]
    k = msgs(spark, ("user", "a"), ("tool", "t"), ("user", "b"), ("assistant", "c"), ("assistant", "d"))
    assert out(chat.merge_roles(k)) == [("user", "a\n\nb")]
    assert out(chat.merge_roles(msgs(spark, ("system", "s"), ("assistant", "x")))) == [("system", "s"), ("user", " ")]
    assert out(chat.merge_roles(msgs(spark, ("tool", "s")))) == [("user", " ")]


def test_extract(spark):
    df = spark.createDataFrame([("d", 1, "b " * 60), ("d", 0, "a " * 60), ("e", 0, "x")], "doc string, chunk_id int, page_content string")
    s = {r.doc: r.reply for r in extract.summarise_parts(df, extract.FirstWords).collect()}
    assert s["d"] == ("a " * 40) + "\n\n" + ("b " * 40) and s["e"] == "x"

    class Broken:
        def complete(self, system, user):
            raise ValueError("no")

    r = extract.extract_sections(df.select("doc", F.col("page_content").alias("text")).where("doc = 'e'"), Broken, {}).first()
    assert r.acids_and_solvents == '{"items":[]}'
    waits, calls = [], iter([ConnectionError(), RuntimeError("Rate limit"), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert extract.with_retries(call, lambda m: 7.0, sleep=waits.append) == "ok" and 2 <= waits[0] <= 2.5 and 7 <= waits[1] <= 7.35
    assert extract.normal_params({"temperature": 0})["do_sample"] is False
    e = extract.embed(df, "page_content").first().embedding
    assert abs(sum(v * v for v in e) - 1) < 1e-5


def test_stream(spark, tmp_path):
    from strataform.streaming.scoring import arriving_items

    src = tmp_path / "in"
    spark.createDataFrame([(1, '{"final_products": {"items": [{}, {}]}}')], "record_id bigint, record string").withColumn("loaded_at", F.current_timestamp()).write.parquet(str(src))
    q = arriving_items(spark, str(src)).writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 2


def test_html_pages_tables_and_the_combined_loader(spark, tmp_path):
    from strataform.sources import pages

    html = "<html><head><title>On wells</title><style>p {}</style></head><body><h1>1. Methods used</h1><p>Water was <b>heated</b> twice.</p><table><tr><th>step</th><th>mL</th></tr><tr><td>wash</td><td>5</td></tr></table><hr><p>Second page here.</p></body></html>"
    text, title, tables = pages.html_parser(html.encode())
    assert title == "On wells" and tables == [("step\tmL\nwash\t5", 0)]
    assert text == ["1. Methods used\nWater was heated twice.", "Second page here."] and pages.html_parser(b"") == ([""], "", [])
    (tmp_path / "a.html").write_text(html)
    docs = pages.read_documents(spark, str(tmp_path), pages.html_parser, "*.html")
    got = [(r.section, r.page_content) for r in segment.document_chunks(docs, pages.table_rows(docs)).orderBy("part", "chunk_id").collect()]
    assert got == [("1. Methods used", "Water was heated twice.\nSecond page here."), ("Table", "step\tmL\nwash\t5")]


def test_prompts_first_document_and_one_call_extraction(spark, tmp_path):
    from strataform.sources import records

    (tmp_path / "b.txt").write_text("Säure")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.md").write_text("no")
    assert records.read_prompts(tmp_path) == {"a": "one", "b": "Säure"}
    docs = spark.createDataFrame([(2, "b"), (1, "c"), (1, "a")], "doc int, text string")
    assert [tuple(r) for r in extract.first_document(docs, "doc", "text").collect()] == [(1, "a")]
    t = spark.createDataFrame([(1, '{"final_products": {"items": [{"name": "x"}], "note": 1}, "target_materials": {"items": 3}}'), (2, "no json"), (3, None)], "doc int, text string")
    got = {r.doc: r for r in extract.extract_all(t, extract.Echo).collect()}
    assert got[1].final_products == '{"items":[{"name":"x"}],"note":1}' and got[1].target_materials == got[2].final_products == got[3].final_products == '{"items":[]}'
