import random

import numpy as np
from pyspark.sql import functions as F

from strataform.llm import langid, leakage, linkage, scans, vocab_map

# ---- reference list ---------------------------------------------------------------------------------------------

VOCAB = [
    (1, "substance", "hydrochloric acid", ["HCl", "muriatic acid"]), (2, "substance", "nitric acid", ["HNO3"]), (3, "substance", "sodium nitrate", ["NaNO3"]), (4, "substance", "sodium nitrite", ["NaNO2"]),
    (5, "substance", "water", ["H2O", "ultrapure water"]), (6, "substance", "n-hexane", ["C6H14"]), (7, "substance", "ammonium hydroxide", ["ammonia solution"]), (8, "substance", "sulfuric acid", []), (9, "substance", "diethyl ether", None),
    (20, "role", "elution", ["stripping"]), (21, "role", "wash", ["rinse"]), (22, "role", "dissolution", []), (23, "role", "conditioning", []), (30, "type", "acid", ["mineral acid"]), (31, "type", "base", []), (32, "type", "solvent", []),
]
NAMES = {
    "HCl": 1, "hydrochlroic acid": 1, "6 M HCl": 1, "acid, hydrochloric": 1, "hydrochloric acid (HCl)": 1, "Muriatic Acid p.a.": 1, "hydrochl. acid": 1, "hydrochloric ac.": 1, " hydrochloric_acid;": 1, "0.5-M nitric acid, analytical grade": 2,
    "sodium nitrate soln.": 3, "NaNO2": 4, "sodium nitritee": 4, "H₂O": 5, "ultrapure water": 5, "heavy ater": 0, "n-heptane": 0, "N-Hexane": 6, "ammonia solution solution": 7, "sulfamic acid": 0, "sulfamic acdi": 0, "sulfurric aid": 8,
    "ether, diethyl": 9, "unknown": 0, "n/a": 0, "Solvanex 40 (?)": 0, "x" * 5000: 0, "hydrofluoric acid": 0, "НCl": 1,
}
ROLES = {"to elute": 20, "eluted": 20, "elut.": 20, "eultion step": 20, "washing of the bed": 21, "wsh": 21, "dissolving": 22, "dissolution / heating": 22, "tracer dilution": 0, "storage": 0, "cond. of column": 23}
TYPES = {"acids": 30, "aicd": 30, "bse": 31, "basic": 31, "gas": 0, "salt": 0, "organic solvent": 32, "strong base": 31}


def test_vocabulary(spark):
    vocab = spark.createDataFrame(VOCAB, "term_id int, kind string, term string, aliases array<string>").withColumn("val", F.lit("clash"))
    rows, want = [], {}
    for field, values in (("name", NAMES), ("role", ROLES), ("type", TYPES)):
        for v, t in values.items():
            rows.append((len(rows), *[v if f == field else None for f in ("name", "role", "type")]))
            want[len(rows) - 1, field] = t
    # names of their own come up again and again
    for field, v in [*(("name", x) for x in ("sulfamic acid", "n-heptane", "hydrofluoric acid", "Sulfamic Acid")), ("role", "tracer dilution")]:
        for _ in range(6):
            rows.append((len(rows), *[v if f == field else None for f in ("name", "role", "type")]))
            want[len(rows) - 1, field] = 0
    rows += [(500, "hydrochloric acid", " ", None), (501, "", "wash", "acid"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "item_id long, name string, role string, type string").withColumn("k", F.lit(1))
    cols = [(df, "name", "name", "substance"), (df, "role", "role", "role"), (df, "type", "type", "type")]
    got = {(r.item_id, r.field): r.term_id for r in vocab_map.found(spark, cols, vocab).collect()}
    assert got == want, {k: (v, want.get(k)) for k, v in got.items() if want.get(k) != v}
    e = df.limit(0)
    assert vocab_map.found(spark, [(e, "name", "name", "substance")], vocab).count() == 0


def test_long_terms_codes_and_formulas(spark):
    """No length is too long, codes with digits are met with slips, formulas only as they are."""
    long = "bis " + " ".join(["diethylhexyl"] * 6) + " phosphoric acid"
    vocab = spark.createDataFrame([(1, "substance", long, None), (2, "substance", "phosphate extractant", ["D2EHPA"]), (3, "substance", "sodium nitrate", ["NaNO3"])], "term_id int, kind string, term string, aliases array<string>")
    typed = {long[:40] + long[41:]: 1, long.upper(): 1, long[:-12]: 0, "d2ehpaa": 2, "D2EHPA": 2, "d3ehpa": 0, "KNO3": 0, "nano3": 3, "NaNO2": 0}
    df = spark.createDataFrame(list(enumerate(typed)), "item_id long, name string")
    got = {x.item_id: x.term_id for x in vocab_map.found(spark, [(df, "name", "name", "substance")], vocab).collect()}
    assert got == dict(enumerate(typed.values()))


def test_unseen_vocabulary(spark):
    """Slips, word order and other names over a list of made-up terms, told apart by how often they come up."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(3, 5)))
    terms = [f"{word()} {word()}" for _ in range(300)]
    others = [f"{t[:-3]}{r.choice('xyz')}{t[-3:-1]}{r.choice('qz')}o" for t in terms[:60]]  # another name, much like a listed one
    vocab = spark.createDataFrame([(i + 1, "substance", t, None) for i, t in enumerate(terms)], "term_id int, kind string, term string, aliases array<string>")

    def slip(t: str) -> str:
        i = r.randrange(1, len(t) - 1)
        return r.choice([t[:i] + t[i + 1 :], t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + t[i] + t[i:], t[:i] + r.choice("aeiourst") + t[i + 1 :]])

    rows = []
    for i, t in enumerate(terms):
        rows += [(t.title(), i + 1)] * 20 + [(slip(slip(t)), i + 1) for _ in range(3)] + [(", ".join(reversed(t.split())), i + 1), (f"6 M {t}", i + 1)]
    for t in others:
        rows += [(t, 0)] * 15 + [(slip(t), 0) for _ in range(2)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "item_id long, name string")
    got = {x.item_id: x.term_id for x in vocab_map.found(spark, [(df, "name", "name", "substance")], vocab).collect()}
    judged = [(got[i], t) for i, (v, t) in enumerate(rows) if i in got]
    right = sum(a == b for a, b in judged if b)
    assert right / sum(b > 0 for _, b in judged) > 0.95 and right / sum(a > 0 for a, _ in judged) > 0.95


def test_pigeonhole_finds_all_within_its_edits(spark):
    """Every string within the edits allowed, by brute force, is found by the segment join."""
    r = random.Random(8)
    vocab = spark.createDataFrame([(1, "substance", "perchloric acid", None), (2, "substance", "tetrahydrofuran", None)], "term_id int, kind string, term string, aliases array<string>")
    typed = []
    for base, t in (("perchloric acid", 1), ("tetrahydrofuran", 2)):
        for _ in range(40):
            w = list(base)
            for _ in range(2):
                i = r.randrange(1, len(w) - 1)
                k = r.randrange(4)
                if k == 0:
                    w[i] = r.choice("abcdefgh")
                elif k == 1:
                    del w[i]
                elif k == 2:
                    w.insert(i, r.choice("xyz"))
                else:
                    w[i], w[i + 1] = w[i + 1], w[i]
            typed.append(("".join(w), t))
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(typed)], "item_id long, name string")
    got = {x.item_id: x.term_id for x in vocab_map.found(spark, [(df, "name", "name", "substance")], vocab, other={}).collect()}
    assert all(got.get(i, t) == t for i, (v, t) in enumerate(typed)), [(v, got.get(i)) for i, (v, t) in enumerate(typed) if got.get(i, t) != t]


# ---- linkage ----------------------------------------------------------------------------------------------------


def test_linkage(spark):
    r = random.Random(1)
    w = lambda n: "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(n))
    books, papers, want = [], [], set()
    pool = [w(4) for _ in range(60)]
    for i in range(120):
        t = f"Study of {w(3)}-{r.randint(10, 99)} from {' '.join(r.sample(pool, 5))}: experience at {w(4)}"
        doi = f"10.1234/x.{i}"
        books.append((10_000 + i, t, doi if i % 3 else None, "Annals of Tests", 1990 + i % 30, 5 + i % 9))
        if i % 2 == 0:
            papers.append((i, t.upper() if i % 4 else t[:-4] + "x", f"doi: {doi};" if i % 5 else None, "Ann. Tests", 5 + i % 9))
            want.add((i, 10_000 + i))
    books += [(20_000, "Erratum to: " + books[0][1], "10.1234/x.e", "Annals of Tests", 1991, 1), (20_001, books[2][1] + ", part II", "10.1234/x.p", "Annals of Tests", 1993, 2), (20_002, books[4][1], books[4][2], "Annals of Tests", 1994, 9), (20_003, None, None, None, None, None)]
    papers += [(500, None, None, None, None), (501, "", "10.1234/x.7", "Ann. Tests", 12), (502, "main.pdf", None, None, 3), (2, *papers[1][1:])]
    want |= {(4, 20_002), (501, 10_007)}
    a = spark.createDataFrame(papers, "paper_id long, title string, doi string, source string, n_pages int").withColumn("rep", F.lit("clash")).withColumn("t", F.lit(1))
    b = spark.createDataFrame(books, "entry_id long, title string, doi string, source string, pub_year int, page_count int")
    ca = {"key": "paper_id", "title": "title", "doi": "doi", "source": "source", "pages": "n_pages", "year": None}
    cb = {"key": "entry_id", "title": "title", "doi": "doi", "source": "source", "pages": "page_count", "year": "pub_year"}
    got = linkage.link(a, b, ca, cb).collect()
    assert {(x.paper_id, x.entry_id) for x in got} == want
    assert all(0.5 < x.confidence <= 1 for x in got)
    assert linkage.link(a.limit(0), b, ca, cb).count() == 0


def test_hot_work_is_a_candidate(spark):
    """A work that holds a third of all classes, each copy with a slip, still meets its entry; so do short titles."""
    r = random.Random(4)
    w = lambda n: "".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(n))
    pool = [w(4) for _ in range(80)]
    title = [w(4) for _ in range(8)]
    papers = [(i, [x if j != i % 8 else f"{x}slip{i}" for j, x in enumerate(title)]) for i in range(200)]
    papers += [(1000 + i, r.sample(pool, 6)) for i in range(200)] + [(3000, ["common", "words"])]
    books = [(1, title), (2, ["common", "words"])] + [(5000 + i, x) for i, x in papers if 1000 <= i < 3000] + [(9000 + i, ["common", "words", *r.sample(pool, 6)]) for i in range(120)]
    a, b = (spark.createDataFrame([(i, x, None) for i, x in rows], "rep long, w array<string>, d string") for rows in (papers, books))
    got = {(x.a, x.b) for x in linkage.candidates(*linkage.known_words(a, b)).collect()}
    assert {(i, 1) for i in range(200)} <= got and (3000, 2) in got
    assert {(1000 + i, 6000 + i) for i in range(200)} <= got and len(got) < 2000


def test_label_model_learns_a_bad_function():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    v = np.where(r.random((4000, 8)) < 0.85, np.where(y[:, None], 1, -1), 0)
    v[:, 7] = r.integers(-1, 2, 4000)  # no information
    v[:, 5] = 0
    p, c = np.unique(v, axis=0, return_counts=True)
    post = linkage.fit(p, c.astype(float))
    back = {tuple(x): q for x, q in zip(p, post, strict=True)}
    assert np.mean([(back[tuple(x)] > 0.5) == t for x, t in zip(v, y, strict=True)]) > 0.995


def test_word_sets_are_linear_and_agree_as_titles_do():
    r = random.Random(3)
    count = {f"w{i}": r.choice([5, 50, 500]) for i in range(300)}
    sets = lambda w: linkage.word_sets(sorted(w), [count[x] for x in sorted(w)], 10_000.0, 64, 0.5)
    met = lambda a, b: len(set(sets(a)) & set(sets(b)))
    enough = stray = 0
    for _ in range(200):
        a = r.sample(sorted(count), 15)
        b = a[:11] + r.sample(sorted(count), 2)  # four words lost, two others
        enough += met(a, b) >= 2
        stray += met(a, r.sample(sorted(count), 15)) >= 2
    assert enough >= 198 and stray <= 2
    assert len(sets(sorted(count))) == 64 and sets([]) == []
    assert met(["w1"], ["w1"]) == 64


def test_candidate_recall_with_slips(spark):
    """Pairs of one work, titles shortened and with slips, are candidates nearly always; others hardly ever."""
    r = random.Random(8)
    pool = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(400)]
    works = [r.sample(pool, 12) for _ in range(800)]
    noisy = [[x if r.random() > 0.1 else x + "q" + str(r.random()) for x in w[: r.randint(8, 12)]] for w in works]
    a = spark.createDataFrame([(i, w, None) for i, w in enumerate(noisy)], "rep long, w array<string>, d string")
    b = spark.createDataFrame([(10_000 + i, w, None) for i, w in enumerate(works)], "rep long, w array<string>, d string")
    got = {(x.a, x.b) for x in linkage.candidates(*linkage.known_words(a, b)).collect()}
    assert sum((i, 10_000 + i) in got for i in range(800)) >= 0.98 * 800 and len(got) < 2 * 800


# ---- scans ------------------------------------------------------------------------------------------------------

CLEAN = [f"The eluate number {i} was evaporated to dryness and the residue was dissolved in dilute nitric acid before the next column was washed with water at {i} mL per minute." for i in range(200)]


def test_scans(spark):
    t = {
        1: "The eluate was evapo-\nrated to dryness.", 2: "The eluate was\nevaporated to dryncss.", 3: "The eluate was evaporated\n- 12 -\nto dryness and the residue\nwas dissolved.", 4: "The eluate was evaporated to\nANNALS OF TESTS  |  VOL. 3\ndryness and the residue was\ndissolved.",
        5: "The eluate was\nevaporated to dryness.", 6: "Results, p. 4", 7: None, 8: "  ", 9: "The c0lumn was washed.", 10: "washed at l2 mL per minute",
    }
    rows = [(1000 + i, c) for i, c in enumerate(CLEAN)] + list(t.items()) + [(1, t[1])]
    df = spark.createDataFrame(rows, "item_id long, source_section string").withColumn("noise", F.lit("clash"))
    got = {(r.item_id, r.noise) for r in scans.found(df).collect()}
    assert got == {(1, "hyphenation"), (2, "misread"), (3, "page_no"), (4, "header"), (9, "misread"), (10, "misread")}
    words, model = scans.fit(df, "source_section")
    assert scans.repair(t[1], words, model)[0] == "The eluate was evaporated to dryness."
    assert scans.repair(t[3], words, model)[0] == "The eluate was evaporated to dryness and the residue was dissolved."
    assert [scans.repair(t[i], words, model)[0] for i in (2, 9, 10)] == ["The eluate was evaporated to dryness.", "The column was washed.", "washed at 12 mL per minute"]
    assert scans.repair("The C0LUMN, (c0lumn) and C0lumn.", words, model)[0] == "The COLUMN, (column) and Column."
    assert scans.found(df.limit(0)).count() == 0


def test_word_knowledge_is_by_shares(spark):
    """Which words are known does not depend on the size of the corpus, nor on the length of a word."""
    long = "".join(chr(97 + i % 26) for i in range(200))
    texts = [f"{'modern ' * 50} modem {long} {'the ' * 30}", "th3 modcrn"]
    for copies in (1, 40):
        df = spark.createDataFrame([(t + f" x{i}y" if i else t,) for t in texts for i in range(copies)], "t string")
        got, ones = scans.word_counts(df, "t")
        words = scans.Words(got, ones)
        assert words.knows("modern") and words.knows("modem") and words.knows(long) and ones >= 82


def test_components_as_an_expression(spark):
    w = ["modern", "Column", "dryness", "1l|!09q68het", "nmduw", "ÜBER", ""]
    df = spark.createDataFrame([(x,) for x in w], "w string")
    assert [r[0] for r in df.select(scans.components_column(F.col("w"))).collect()] == [scans.components(x) for x in w]


def test_headers_of_unseen_styles():
    """Running headers in styles that the training does not write."""
    words = scans.Words([(w, 50, 50) for w in {w.strip(".,") for c in CLEAN for w in c.split()}])
    model = scans.train_lines(CLEAN[:150], words, seed=3)
    r = random.Random(4)
    styles = [lambda: f"© {r.randint(1970, 2024)} Belkor Society", lambda: f"BELKOR & TASVEN", lambda: f"Proc. Belk. Soc. {r.randint(1, 90)}:{r.randint(1, 900)}", lambda: f"Tasven, Q. / Minlura {r.randint(1, 90)}", lambda: f"Received 3 May {r.randint(1970, 2024)}; Belkor Press"]
    tp = fp = fn = 0
    for k, c in enumerate(CLEAN[100:200]):
        w = c.split()
        lines = [" ".join(w[:10]), " ".join(w[10:20]), " ".join(w[20:])]
        gold = [0, 0, 0]
        if k % 2:
            lines.insert(1, r.choice(styles)())
            gold.insert(1, scans.HEADER)
        got = model.decode(scans.line_features(lines, words))
        tp += sum(a == b == scans.HEADER for a, b in zip(got, gold))
        fp += sum(a == scans.HEADER != b for a, b in zip(got, gold))
        fn += sum(b == scans.HEADER != a for a, b in zip(got, gold))
    assert tp / (tp + fn) >= 0.9 and tp / (tp + fp) >= 0.9, (tp, fp, fn)


def test_copies_of_a_slip_stay_misread(spark):
    hot = [(5000 + i, f"The {w} column was washed twice.") for w in ("c0lumn", "1O") for i in range(300)]
    rows = [(1000 + i, c) for i, c in enumerate(CLEAN)] + [(i if "0" in t else i + 1000, t) for i, t in hot]
    df = spark.createDataFrame(rows, "item_id long, source_section string")
    got = {(r.item_id, r.noise) for r in scans.found(df).collect()}
    assert got == {(i, "misread") for i, _ in rows if i >= 5000}
    hot_clean = spark.createDataFrame([(i, CLEAN[0]) for i in range(500)] + list(enumerate(CLEAN)), "item_id long, source_section string")
    seen = []
    real, scans.train_lines = scans.train_lines, lambda texts, words: seen.extend(texts) or real(texts, words)
    try:
        scans.fit(hot_clean, "source_section", sample=100)
    finally:
        scans.train_lines = real
    assert len(seen) == len(set(seen)) == 100


def test_line_model_on_held_out_lines():
    words = scans.Words([(w, 50, 50) for w in {w.strip(".,") for c in CLEAN for w in c.split()}])
    model = scans.train_lines(CLEAN[:150], words, seed=3)
    r = random.Random(9)
    right = total = 0
    for c in CLEAN[150:]:
        w = c.split()
        lines = [" ".join(w[:10]), " ".join(w[10:20]), " ".join(w[20:])]
        kind = r.choice([scans.HEADER, scans.PAGE])
        x = scans._header(r, ["column", "nitric"], ["Column"]) if kind == scans.HEADER else scans._page(r)
        lines.insert(1, x)
        right += model.decode(scans.line_features(lines, words)) == [0, kind, 0, 0]
        total += 1
    assert right / total > 0.85


def test_blank_lines_part_paragraphs():
    words = scans.Words([(w, 50, 50) for w in {w.strip(".,") for c in CLEAN for w in c.split()}])
    model = scans.train_lines(CLEAN[:150], words, seed=3)
    one, two = CLEAN[3], CLEAN[4]
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 10]) for i in range(0, len(t.split()), 10))
    fix = lambda t: scans.repair(t, words, model)[0]
    assert fix(f"{wrap(one)}\n\n{wrap(two)}\n") == f"{one}\n\n{two}"
    assert fix(f"{wrap(one)}\n    {wrap(two)}") == f"{one}\n\n{two}"
    assert fix(f"{wrap(one)}\n\n{wrap(two)}\n\n{wrap(CLEAN[5])}") == f"{one}\n\n{two}\n\n{CLEAN[5]}"
    assert fix(f"{wrap(one)}\r\n \r\n- 12 -\r\n\r\n{wrap(two)}") == f"{one}\n\n{two}"
    inside = wrap(one).replace("\n", "\n\n", 1)
    assert fix(inside) == one and fix(inside.replace("\n\n", "\n\n- 12 -\n\n")) == one and fix(wrap(one)) == one


# ---- leakage ----------------------------------------------------------------------------------------------------


def test_leakage(spark):
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("bar", "cel", "dom", "fig", "gam", "hol", "jin", "kel") for b in ("ton", "mark", "wick", "sen", "dal", "vor", "lum", "pik")]
    item = lambda: " ".join(r.choice(words) for _ in range(40))
    items = {i: item() for i in range(1, 9)}
    shared = "one quick phrase that many different items all share word for word here"
    items[9], items[10] = f"{shared} {item()}", f"{shared} {item()}"
    w = items[1].split()
    changed = [x if i % 7 else "changed" for i, x in enumerate(items[2].split())]
    slips = [x[:-2] + x[-1] + x[-2] if i % 4 == 0 else x for i, x in enumerate(items[3].split())]
    docs = [
        (1, "intro text. " + items[1].upper().replace(" ", ",\n", 5) + " outro."), (2, "a b c " + " ".join(changed) + " d e f"), (3, " ".join(slips)), (4, " ".join(w[:22])), (5, " ".join(w[:17])), (6, " ".join(w[:12]) + " some other words in between go here now " + " ".join(w[25:36])),
        (7, shared + " and nothing else"), (8, None), (9, ""), (10, "lorem " * 50_000 + items[4]), (11, items[5] + " " + items[6]), (12, items[5]), (13, items[5]),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(list(items.items()) + [(77, "too short an item"), (78, None)], "item_id long, text string")
    for bits in (27, 4):
        got = {(x.doc_id, x.item_id) for x in leakage.scan(d, b, "doc_id", "text", "item_id", "text", bits=bits).collect()}
        assert got == {(1, 1), (2, 2), (3, 3), (4, 1), (6, 1), (10, 4), (11, 5), (11, 6), (12, 5), (13, 5)}
    assert leakage.scan(d, b.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.scan(d.limit(0), b, "doc_id", "text", "item_id", "text").count() == 0


def test_versions_of_an_item_are_all_reported(spark):
    """Items of equal text, and an excerpt of another item, are no less leaked for being there twice."""
    w = [f"{a}{b}" for a in ("bar", "cel", "dom", "fig", "gam", "hol") for b in ("ton", "mark", "wick", "sen", "dal", "vor", "lum")]
    whole = " ".join(w)
    items = [(1, whole), (2, whole.upper()), (3, " ".join(w[:20])), (4, None), (5, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {whole} it ends"), (2, " ".join(w[:30])), (3, " ".join(w[:9])), (1, "nothing")], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in leakage.scan(docs, b, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_alignment_by_rows_equals_cell_by_cell():
    r = random.Random(2)
    for _ in range(200):
        m, n = r.randint(1, 12), r.randint(1, 25)
        eq = np.array([[r.random() < 0.3 for _ in range(n)] for _ in range(m)])
        free = np.array([r.random() < 0.9 for _ in range(m)])
        h = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                if free[i]:
                    h[i + 1][j + 1] = max(0, h[i][j] + (1 if eq[i, j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        score, a, b, matched = leakage.best_piece(eq, free)
        assert score == max(map(max, h)) and 0 <= a <= b <= m and matched >= score


def test_long_windows_lose_nothing():
    item = [f"word{chr(97 + i)}{chr(110 + i % 9)}x" for i in range(20)]
    doc = ["filler"] * 5000
    doc[4321:4341] = item
    assert leakage.held(item, doc, list(range(0, 5000, 10)), 0.5, 8) == (1.0, 1)
    assert leakage.held(item, [], [0], 0.5, 8) == (0.0, 0)


# ---- language ---------------------------------------------------------------------------------------------------

SAY = {
    "en": ["The solution was washed with the remaining water after {} hours.", "We found that the yield of this batch reached {} percent.", "Nothing else could be detected in these fractions within {} days."],
    "de": ["Die Lösung wurde nach {} Stunden mit dem restlichen Wasser gewaschen.", "Wir fanden, dass die Ausbeute dieser Charge {} Prozent erreichte.", "In diesen Fraktionen konnte binnen {} Tagen nichts nachgewiesen werden."],
    "fr": ["La solution a été lavée avec le reste de l'eau après {} heures.", "Nous avons trouvé que le rendement de ce lot atteignait {} pour cent.", "Rien d'autre n'a pu être détecté dans ces fractions en {} jours."],
    "es": ["La disolución se lavó con el resto del agua después de {} horas.", "Encontramos que el rendimiento de este lote llegó al {} por ciento.", "No se pudo detectar nada más en estas fracciones en {} días."],
    "pt": ["A solução foi lavada com o resto da água depois de {} horas.", "Verificámos que o rendimento deste lote chegou a {} por cento.", "Não foi possível detetar mais nada nestas frações em {} dias."],
}


def test_language(spark):
    say = lambda g, i: " ".join(s.format(i) for s in SAY[g])
    rows = [(100 * k + i, say(g, i), g) for k, g in enumerate(SAY) for i in range(1, 31)]
    extra = [
        (9001, say("en", 7), None), (9002, say("de", 7), "en"), (9003, say("fr", 7), "French"), (9004, say("es", 7), "es-MX"), (9005, say("en", 1) + "\n" + say("pt", 2), "en"), (9006, "1. Einleitung\n" + say("en", 3), "en"),
        (9007, "The solution was washed („Heiße Zelle“) with water after two hours.", "en"), (9008, None, None), (9009, "", "xx"), (9010, "* * *", " "), (9011, say("pt", 4), "??"), (9012, (say("en", 1) + " ") * 300, "eng"), (9013, say("en", 1) + " " + say("en", 2), "deu"),
    ]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("best", F.lit("clash"))
    got = {(r.doc_id, r.lang) for r in langid.found(df, "doc_id", "text", "lang").collect()}
    assert {g for g in got if g[0] < 9000} == set()
    assert got == {(9001, "en"), (9002, "de"), (9005, "en"), (9005, "pt"), (9011, "pt"), (9013, "en")}
    assert langid.found(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_held_out_sentences_and_segments(spark):
    rows = [(g, [langid.windows(SAY[g][k].format(i))]) for g in SAY for k in range(3) for i in range(40)]
    net = langid.train(rows, per_language=400, epochs=4)
    held = [(g, s.format("1.5")) for g in SAY for s in SAY[g]]
    assert all(langid.read_text(s, net)[0][2] == g for g, s in held)
    df = spark.createDataFrame([(1, f"{SAY['en'][0]} {SAY['en'][1]}\n\n{SAY['de'][0]}".replace("{}", "3"))], "doc_id long, text string")
    s = langid.segments(df, "doc_id", "text", net).orderBy("segment_no").collect()
    assert [(x.segment_no, x.lang) for x in s] == [(0, "en"), (1, "de")] and all(x.confidence > 0.5 for x in s)


def test_asides_and_samples():
    long = "single foreign term " * 40
    assert np.array_equal(langid.windows(f"Das Wasser ({long}) war kalt."), langid.windows("Das Wasser () war kalt.".replace("()", "")))
    text = " ".join(SAY["en"][i % 3].format(i) for i in range(3000))  # sentences from anywhere in a very long text
    found = langid.sample_sentences(text, np.random.default_rng(1), 12)
    assert len(found) == 12 and all(w.shape[1] == langid.WINDOW for w in found)
    assert langid.windows("x" * 200).shape == (3, 64) and langid.windows("x" * 70).shape == (1, 64) and langid.windows("").shape == (1, 64)


def test_calibration():
    r = np.random.default_rng(0)
    y = r.integers(0, 5, 4000)
    z = np.log(r.dirichlet(np.ones(5) * 0.5, 4000))
    p = np.exp(z)
    y = np.array([r.choice(5, p=x) for x in p])
    assert 0.8 < langid.calibrate(z, y) < 1.6 and 0.2 < langid.calibrate(4 * z, y) < 0.5


def test_sentences():
    t = "RESULTS\nThe yield was 3.5 % in the end. Then all was over now, see p. 4. short one. and\nmore without an end"
    assert [t[a:b].strip() for a, b in langid.sentences(t)][0] == "The yield was 3.5 % in the end."
    assert langid.sentences("Introduction") == [] and langid.sentences("* * *") == [] and langid.sentences("") == []
