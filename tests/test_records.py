import json

from pyspark.sql import functions as F

from strataform.operators import joins, metrics, nested, report
from strataform.sources import pages, records, sinks


def record(**sections):
    return json.dumps({s: {"items": i} for s, i in sections.items()})


def test_flatten_edge_cases(spark):
    rows = [
        (1, '{"final_products": {"items": [{"name": "a"}, "bad", 3, null, [{"x": 1}], {}]}}'),
        (2, None), (3, ""), (4, "null"), (5, '[{"final_products": {"items": [{}]}}]'), (6, '{"final_products": {"items": [{}]}} trailing'),
        (7, '{"final_products": {"items": [{}'), (8, '{"final_products": [{"name": "x"}]}'), (9, '{"final_products": {"items": {"name": "x"}}}'), (10, "{}"), (11, '{"final_products": {"items": [{}]}}]'),
        (12, ' {"resins_or_columns": {"items": [{"name": "' + "long " * 20000 + '"}]}, "final_products": {"items": [{"sub": {"items": [{"name": "n"}]}}]}} '),
    ]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "record_id long, record string, section string, item_no int")
    got = {tuple(r) for r in nested.p7_found(df).collect()}
    assert got == {(1, "final_products", 0), (1, "final_products", 5), (12, "resins_or_columns", 0), (12, "final_products", 0)}
    assert nested.p7_found(df.limit(0)).count() == 0
    assert nested.p7_found(df.unionByName(df)).count() == 2 * len(got)


def test_section_table_keeps_links(spark):
    df = spark.createDataFrame([(5, record(final_products=[{"name": "x", "yield": "3 %"}, "no", {"name": 4.5, "yield_": None, "purity": {"a": 1}}]))], "record_id long, record string")
    t = nested.section_table(nested.flatten_items(df, "record_id", "record"), "final_products").orderBy("item_no").collect()
    assert [(r.record_key, r.item_no, r.name, r.yield_, r.purity) for r in t] == [(5, 0, "x", "3 %", None), (5, 2, "4.5", None, '{"a":1}')]


def test_repeated_keys_keep_the_last(spark):
    rows = [
        (1, '{"final_products": {"items": [{"name": "x", "name": "y"}]}, "a": 1, "a": 2}'), (2, '{"final_products": {"items": [{}]}, "final_products": {"items": [{}, {"name": "z"}]}}'),
        (3, '{"paper_metadata": {"title": "old", "title": "new"}, "final_products": {"items": [{"name": "x"}, {"name": "y", "name": "'), (4, '{"a": 1, "a": 2} {}'),
    ]
    df = spark.createDataFrame(rows, "record_id long, record string")
    assert sorted(tuple(r) for r in nested.p7_found(df).collect()) == [(1, "final_products", 0), (2, "final_products", 0), (2, "final_products", 1)]
    t = nested.section_table(nested.flatten_items(df, "record_id", "record"), "final_products").collect()
    assert sorted((r.record_key, r.item_no, r.name) for r in t if r.name) == [(1, 0, "y"), (2, 1, "z")]
    assert sorted(r.record_key for r in nested.record_table(df, "record_id", "record").collect()) == [1, 2]
    whole = spark.createDataFrame([(1, '{"target_materials": {"items": []}, "x": {"k": 1, "k": 2}}')], "i int, t string")
    assert records.with_record_flag(whole, "t").first().is_record


def test_all_flat_tables(spark, tmp_path):
    from strataform.plans import registry

    meta = {"paper_metadata": {"title": "T", "doi": "10.1/a", "source": "S"}}
    items = {s: [{f: f"{f} of {s}" for f in nested.SECTION_FIELDS[s]}, {}] for s in nested.FLAT_SECTIONS}
    rows = [(1, json.dumps(meta | json.loads(record(**items)))), (2, "{}"), (3, '{"cut'), (1, "{}")]
    spark.createDataFrame(rows, "record_id long, record string").write.parquet(str(tmp_path / "extraction_records.parquet"))
    q = registry.queries()
    for name, s in {"p7_acid_table": "acids_and_solvents", "p7_elution_table": "elution_conditions", "p7_product_table": "final_products", "p7_resin_table": "resins_or_columns"}.items():
        got = sorted((r.asDict() for r in q[name](spark, str(tmp_path)).collect()), key=lambda r: r["item_no"])
        assert got == [{"record_key": 1, "item_no": 0} | items[s][0], {"record_key": 1, "item_no": 1} | dict.fromkeys(nested.SECTION_FIELDS[s])]
    got = sorted(q["p7_record_table"](spark, str(tmp_path)).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, "T", "10.1/a", "S"), (1, None, None, None), (2, None, None, None)]


def test_scores(spark):
    full = record(
        target_materials=[{"name": "Nickel", "isotope": "64Ni", "chemical_formula": "Ni", "physical_form": "foil", "source_section": "s"}],
        acids_and_solvents=[{"name": "HCl", "type": "acid", "concentration": "6 M", "role": "wash", "source_section": "s"}, {"name": "HCl", "type": "acid", "concentration": "6.0M", "role": None, "source_section": " "}],
        resins_or_columns=[{"name": "AG 1-X8", "role": "sep", "source_section": "s"}], elution_conditions=[{"eluent": "6 M HCl", "concentration": "6 M", "source_section": "s"}, {"source_section": "s"}], final_products=[{"name": "64Cu", "source_section": "s"}],
    )
    df = spark.createDataFrame([(1, full)], "record_id long, record string")
    flat = nested.flatten_items(df, "record_id", "record", list(metrics.SECTIONS))
    keys = {(r.section, r.key) for r in metrics.item_scores(flat).collect()}
    assert keys == {("target_materials", "64ni|ni|nickel"), ("acids_and_solvents", "hcl|acid|6 m"), ("resins_or_columns", "ag 1x8"), ("elution_conditions", "hcl|6 m"), ("elution_conditions", ""), ("final_products", "64cu|64cu")}
    r = metrics.score_records(flat).first()
    assert (r.completeness, r.items_total, r.duplicates) == (1.0, 7, 2)
    assert abs(r.schema_validity - 16 / 19) < 1e-9 and abs(r.heuristic_hallucination - 2 / 7) < 1e-9
    assert abs(r.heuristic_accuracy - (1 + 1 + 1 + 1 + 1 + 0 + 0.6) / 7) < 1e-9
    pair = metrics.score_records(flat).select(F.col("keys").alias("pred"), F.col("keys").alias("gold"))
    g = metrics.gold_report(pair).first()
    assert g.micro_f1 == 1.0 and g.macro_f1 == 1.0 and g.hallucination_rate == 0.0


def test_records_without_items_are_scored(spark):
    rows = [(1, record(final_products=[{"name": "x", "source_section": "s"}])), (2, "{}"), (3, record(final_products=[])), (4, "[]"), (5, None), (6, '{"cut')]
    df = spark.createDataFrame(rows, "record_id long, record string")
    r = {x.record_key: x for x in metrics.score_records(nested.flatten_items(df, "record_id", "record", list(metrics.SECTIONS), records=True)).collect()}
    assert sorted(r) == [1, 2, 3]
    assert (r[1].completeness, r[1].items_total, r[1].sections) == (0.2, 1, 1)
    for k in (2, 3):
        assert (r[k].completeness, r[k].items_total, r[k].duplicates, r[k].duplicate_rate, r[k].schema_validity, r[k].heuristic_accuracy, r[k].heuristic_hallucination, r[k].keys) == (0.0, 0, 0, 0.0, 0.0, 0.0, 0.0, {})


def test_sources_and_cascade(spark, tmp_path):
    gold, out = tmp_path / "gold", tmp_path / "out"
    gold.mkdir()
    meta = lambda doi, title: {"paper_metadata": {"doi": doi, "title": title, "source": ""}, "target_materials": {"items": []}}
    for n, (d, t) in {"A.json": ("10.1/a", "alpha study of copper"), "B.json": ("10.1/b", "beta study of zinc"), "bad.json": (None, None)}.items():
        (gold / n).write_text("[1]" if n == "bad.json" else json.dumps(meta(d, t)))
    for path, body in {"exp18/rag_output/A.pdf.json": meta("", ""), "exp19/full_summary/other.pdf.json": meta("10.1/b", ""), "exp19/full_summary/x.pdf.json": meta("", "alpha study of coper"), "exp19/full_summary/deep/no.json": meta("", ""), "exp/rag_output/zzz.pdf.json": meta("", "q")}.items():
        p = out / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps(body))
    g, p = records.gold_records(spark, str(gold)), records.predicted_records(spark, str(out))
    assert g.count() == 2 and p.count() == 4
    m = {r.path.split("/")[-1]: (r.gold_path and r.gold_path.split("/")[-1], r.mode) for r in joins.cascade(p, g).collect()}
    assert m == {"A.pdf.json": ("A.json", "stem"), "other.pdf.json": ("B.json", "doi"), "x.pdf.json": ("A.json", "fuzzy"), "zzz.pdf.json": (None, None)}
    (out / "exp18" / "timing.json").write_text('{"file": "A.pdf", "rag_time": 1}{"file": "A.pdf", "rag_time": 2.5}\n{"x": 1}')
    t = records.timing_files(spark, str(out)).first()
    assert (t.exp, t.stem, t.rag_time, t.full_summary_time) == (18, "a", 2.5, 0.0)
    r = joins.with_runtime(p, records.timing_files(spark, str(out))).where("exp = 18").first()
    assert r.runtime_seconds == 2.5
    none = {r.mode for r in joins.cascade(p, g.limit(0)).collect()}
    assert none == {None}
    assert records.model_name({"llm_model": "m", "model": 3}) == "m"
    df = spark.createDataFrame([(1, '{"target_materials": {"items": []}}'), (2, '{"target_materials": []}'), (3, None)], "i int, t string")
    assert [x.is_record for x in records.with_record_flag(df, "t").orderBy("i").collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    assert sinks.next_run_folder(tmp_path / "none").name == "exp"
    (tmp_path / "exp").mkdir()
    assert sinks.next_run_folder(tmp_path).name == "exp2"
    (tmp_path / "exp7").mkdir()
    assert sinks.next_run_folder(tmp_path).name == "exp8"
    df = spark.createDataFrame([(1, True, None), (2, None, 0.5)], "exp int, task_success boolean, micro_f1 double")
    sinks.write_report(report.flat_report(df), str(tmp_path / "csv"), ["exp"])
    lines = next((tmp_path / "csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == ",".join(report.REPORT_COLUMNS) and lines[1].startswith("1,") and ",True," in lines[1]
    sinks.append_timing(tmp_path / "t.json", {"file": "a"})
    sinks.append_timing(tmp_path / "t.json", {"file": "b"})
    assert (tmp_path / "t.json").read_text().count("}{") == 1
    d = spark.createDataFrame([("d", 1, "S", "one two"), ("d", 2, "T", "one")], "doc string, o int, s string, t string")
    assert sinks.section_dump(d, "doc", "s", "t", "o").first().dump == "[S]\n" + "-" * 80 + "\none two"


def test_metadata(spark):
    df = spark.createDataFrame([("d", 0, "no doi", "T"), ("d", 2, "see 10.1234/ab.c, and 10.9999/zz", "T"), ("d", 5, "10.5555/late", "T"), ("e", 0, "x", None)], "doc string, page int, text string, title string")
    got = {r.doc: (r.title, r.doi) for r in pages.metadata(df).collect()}
    assert got == {"d": ("T", "10.1234/ab.c,"), "e": ("", "")}


def test_reports(spark):
    rows = [(18, "RAG", 0.5, 0.1, 10.0, True, 3), (18, "RAG", 0.7, 0.3, None, None, 4), (21, "RAG", 0.0, 0.0, 1.0, False, 0), (19, "FULL", 0.2, 0.2, 2.0, False, 1)]
    df = spark.createDataFrame(rows, "exp int, method string, micro_f1 double, hallucination_rate double, runtime_seconds double, task_success boolean, items_total int")
    s = {r.method: r for r in report.method_summary(report.poster_scope(df)).collect()}
    assert s["RAG"].n == 2 and abs(s["RAG"].micro_f1_mean - 0.6) < 1e-9 and s["RAG"].task_success_rate == 0.5 and s["RAG"].runtime_seconds_median == 10.0
    b = report.box_stats(spark.createDataFrame([("a", float(i)) for i in range(1, 10)] + [("a", 100.0)], "g string, v double"), "g", "v").first()
    assert (b.q1, b.median, b.q3, b.low, b.high) == (3.25, 5.5, 7.75, 1.0, 9.0)
    assert report.cube_means(df).count() == 1 + 3 + 2 + 3


def test_nearest_by_text_equals_all_pairs(spark):
    import random

    r = random.Random(1)
    w = lambda: "".join(r.choice("abcdef ") for _ in range(r.randint(0, 14)))
    preds, gold = [(f"p{i}", w(), w(), w()) for i in range(40)], [(f"g{i:02}", w(), w(), w()) for i in range(30)]
    p = spark.createDataFrame(preds, "path string, title string, source string, stem string")
    g = spark.createDataFrame(gold, "gold_path string, title string, source string, stem string")
    got = {x.path: (x.fuzzy_gold, round(x.ratio, 9)) for x in joins.nearest_by_text(p, g, block=7).collect()}
    for a in preds:
        ratio, _, path = max((max((joins.sequence_ratio(x, y) for x in a[1:] if x for y in b[1:] if y), default=0.0), -i, b[0]) for i, b in enumerate(gold))
        assert got[a[0]] == (path if ratio >= 0.65 else None, round(ratio, 9))
