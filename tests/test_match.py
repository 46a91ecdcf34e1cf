import random

from pyspark.sql import functions as F

from strataform.operators.match import exact_counts, jaccard, match_counts, prf


def counts(spark, pred, gold, iso=False, f=None):
    df = spark.createDataFrame([(pred, gold)], "p array<string>, g array<string>")
    c = (f or (lambda p, g: match_counts(p, g, iso)))(F.col("p"), F.col("g"))
    return tuple(df.select(c.alias("c")).first()["c"])


def brute(pred, gold, iso):
    """The definition, spelt out."""

    def token(k):
        import re

        return next((x for x in k.split("|") if re.fullmatch(r"\d{1,3}[a-z]{1,3}", x)), None)

    def fits(p, g):
        if p == g or (iso and token(p) and token(p) == token(g)):
            return True
        if not p or not g:
            return False
        free = list(enumerate(p.split("|")))
        for part in g.split("|"):
            hit = next((x for x in free if x[1] == part or (x[1] and part and any("a" <= c <= "z" for c in part) and part in x[1])), None)
            if hit is None:
                return False
            free.remove(hit)
        return True

    left, tp = sorted(gold), 0
    for p in sorted(pred):
        g = next((g for g in left if fits(p, g)), None)
        if g is not None:
            left.remove(g)
            tp += 1
    return tp, len(pred) - tp, len(gold) - tp


def test_cases(spark):
    assert counts(spark, ["a iron zz", "iron"], ["iron", "zz"]) == (1, 1, 1)
    assert counts(spark, ["natural iron"], ["iron"]) == (1, 0, 0)
    assert counts(spark, ["resins_or_columns:natural iron"], ["resins_or_columns:iron"]) == (0, 1, 1)
    assert counts(spark, ["hcl|0.1 m"], ["hcl|1 m"]) == (1, 0, 0)
    assert counts(spark, ["hcl|1 m"], ["hcl|0.1 m"]) == (0, 1, 1)
    assert counts(spark, ["64ni|ni|nickel-64"], ["ni|nickel"]) == (1, 0, 0)
    assert counts(spark, ["58co|x"], ["58co|y"], iso=True) == (1, 0, 0)
    assert counts(spark, ["58co|x"], ["58co|y"]) == (0, 1, 1)
    assert counts(spark, [], []) == (0, 0, 0)
    assert counts(spark, None, ["a"]) == (0, 0, 1)


def test_against_brute_force(spark):
    r = random.Random(4)
    parts = ["hcl", "0.1 m", "1 m", "ni", "nickel", "64ni", "iron", "natural iron", "acid", ""]
    cases = []
    for _ in range(150):
        mk = lambda: sorted({"|".join(r.sample(parts, r.randint(1, 3))) for _ in range(r.randint(0, 4))})
        cases.append((mk(), mk()))
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(cases)], "i int, p array<string>, g array<string>")
    for iso in (False, True):
        got = {x["i"]: tuple(x["c"]) for x in df.select("i", match_counts(F.col("p"), F.col("g"), iso).alias("c")).collect()}
        for i, (p, g) in enumerate(cases):
            assert got[i] == brute(p, g, iso), (p, g, iso)


def test_rates(spark):
    df = spark.createDataFrame([(0, 0, 0), (2, 1, 1)], "tp int, fp int, fn int").select(F.struct("tp", "fp", "fn").alias("c"))
    rows = df.select(jaccard(F.col("c")).alias("j"), prf(F.col("c"))["f1"].alias("f1")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0), (0.5, 2 / 3)]
    assert counts(spark, ["a", "b"], ["b", "c"], f=exact_counts) == (1, 1, 1)
