"""Match records of two sources that share no key, each match with a confidence.

Candidates share an identifier text, or at least two of `sets` word sets of their titles. A title's word sets are the
beginnings of as many random orders of all its words (rare words tend to come first), each as long as it takes to be
rare in the whole data; so their number is linear in the data, however many words a title has and however common
they are, and titles that share most of their words share many of them. Labelling functions vote on each
candidate: match, no match, or abstain. A generative label model (two latent classes, functions independent
given the class but for pairs found to be correlated, which are then modelled jointly) is fitted by EM on the
histogram of vote patterns and yields the posterior of each pattern; abstentions count for neither class. The histogram has at most 3 to the number of
functions entries, whatever the size of the data.

Records with equal attributes are handled once as a class and joined back to their ids at the end, so that copies
of one record, however many, cost one candidate.

Cases: null and blank attributes abstain; unusable titles leave the decision to identifier, pages and source;
ties at a posterior of one half are no match; repeated rows are all linked; very long titles are compared whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.lookalikes import fold
from strataform.functions.stage import staged
from strataform.operators.skew import hot_split_lookup
from strataform.session import cut

#: Votes in this order; see votes().
FUNCTIONS = ("identifier", "words", "letters", "nuclide", "leftover", "journal", "year", "pages")
MATCH, NONE, DIFFER = 1, 0, -1


def canonical_title(c: Column) -> Column:
    t = F.regexp_replace(F.lower(fold(c)), r"<sup>\s*(\d+)\s*</sup>\s*([a-z]+)", "$2-$1")
    t = F.regexp_replace(t, r"<[^>]{0,20}>", "")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.translate(t, "‐‑‒–—−", "------")
    t = F.regexp_replace(t, r"([a-z])-\s*[\r\n]+\s*([a-z])", "$1$2")
    t = F.regexp_replace(t, r"\b(\d{2,3})-([a-z]{3,})", "$2-$1")
    t = F.regexp_replace(t, r"^\s*(\[pdf\]|research article|original article|full paper|article|paper|\d{1,2}\.)\s*[-:.]?\s+", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def kind(t: Column) -> Column:
    """What makes a work of its own of a title: erratum, reply, part number."""
    note = F.regexp_extract(t, r"^(erratum|corrigend|correction|reply|response|comment|addend|retract|supplement|author)", 1)
    part = F.regexp_extract(t, r"(?:\bpart|[.,:(]) ?(ii|iii|iv|v|vi|[2-9])\b(?!-)", 1)
    number = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(part, "^iii$", "3"), "^ii$", "2"), "^iv$", "4"), "v", "5")
    return F.concat_ws("|", F.nullif(note, F.lit("")), F.nullif(number, F.lit("")))


def identifier(c: Column) -> Column:
    """The DOI in a text, however it is written; null if there is none."""
    d = F.regexp_replace(F.regexp_extract(F.lower(fold(c)), r"(10\. ?\d{4,9} ?/ ?[^\s;,]+)", 1), r"\s", "")
    return F.nullif(F.regexp_replace(d, r"[.)\]}>]+$", ""), F.lit(""))


def journal(c: Column) -> Column:
    """Initials of the words of a source's name, without volume and year."""
    words = F.filter(F.split(F.lower(fold(c)), r"[^\p{L}-]+"), lambda w: (w != "") & ~w.isin("of", "the", "and", "for", "in", "on", "vol", "no"))
    return F.nullif(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), F.lit(""))


def year(c: Column) -> Column:
    return F.regexp_extract(c, r"\b((?:19|20)\d\d)\b", 1).try_cast("int")


def profiles(df: DataFrame, key: str, title: str, doi: str, source: str, pages: str, year_col: str | None) -> DataFrame:
    """rep (the smallest key) and attributes of each class of records with equal attributes."""
    raw = df.groupBy(F.col(title).alias("title"), F.col(doi).alias("doi"), F.col(source).alias("source"), F.col(pages).cast("int").alias("pages"), (F.col(year_col).cast("int") if year_col else F.lit(None).cast("int")).alias("y")).agg(F.min(key).alias("rep"))
    p = staged(raw, {"t": canonical_title(F.col("title")), "d": identifier(F.col("doi")), "j": journal(F.col("source")), "yr": F.coalesce("y", year(F.col("source")))})
    tokens = F.array_distinct(F.filter(F.split("t", r"[^a-z0-9äöüéèêñç-]+"), lambda w: (F.length(w) > 1) & ~w.isin("the", "of")))
    p = staged(p, {"w": tokens, "nuclides": F.array_distinct(F.regexp_extract_all("t", F.lit(r"\b([a-z]{3,}-\d{2,3})\b"), 1)), "kind": kind(F.col("t"))})
    return p.select("rep", "t", "w", "d", "j", "yr", "pages", "nuclides", "kind")


def word_sets(words: list[str], counts: list[int], total: float, sets: int, expected: float) -> list[int]:
    """Hashes of a title's word sets, one per order. Order j sorts the words by a hash of word and j, weighted so that a
    word comes first the more often the rarer it is; its set is the shortest beginning that a title is expected to
    share with at most `expected` unrelated others (total * product of the words' shares), or all words. Two titles
    agree on a set of one word with the chance of the weighted Jaccard similarity of their words."""
    if not words:
        return []
    share = np.minimum(np.array(counts, dtype=float) / total, 1.0)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    mixed = (h[None, :] ^ _SALTS[:sets, None]) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    u = ((mixed >> np.uint64(11)).astype(float) + 1) / 2.0**53
    weight = 1e-3 - np.log(share)
    order = np.argsort(-np.log(u) / weight, axis=1, kind="stable")
    rate = np.log(total) + np.cumsum(np.log(share)[order], axis=1)
    rare = rate <= np.log(expected)
    length = np.where(rare.any(1), rare.argmax(1), len(words) - 1)
    sums = np.cumsum((h * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h >> np.uint64(29)))[order], axis=1)  # a set, whatever the order
    return (sums[np.arange(sets), length] + np.arange(sets, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


_SALTS = np.random.default_rng(17).integers(0, 2**63, 1024, dtype=np.uint64)


def known_words(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles with k: the title words that both sources know (so without slips), in alphabetical order."""
    wa, wb = a.select("rep", F.explode("w").alias("w")), b.select("rep", F.explode("w").alias("w"))
    both = cut(wa.groupBy("w").agg(F.count(F.lit(1)).alias("na")).join(wb.groupBy("w").agg(F.count(F.lit(1)).alias("nb")), "w").select("w", (F.col("na") + F.col("nb")).alias("n")))

    def known(p: DataFrame, w: DataFrame) -> DataFrame:
        k = hot_split_lookup(w, both, ["w"], "n").groupBy("rep").agg(F.array_sort(F.collect_list("w")).alias("k"))
        return cut(p.join(k, "rep", "left").withColumn("k", F.coalesce("k", F.expr("CAST(array() AS array<string>)"))))

    return known(a, wa), known(b, wb)


def candidates(a: DataFrame, b: DataFrame, sets: int = 64, expected: float = 0.5, meet: int = 2) -> DataFrame:
    """(a, b): pairs of classes (rep, d, k) that share an identifier, or `meet` of the `sets` word sets of their titles.

    Titles with the same words are one title: words are counted over such titles, not over classes, so that a work
    with very many copies does not make its own words common, and sets are built and compared once a title. No word
    is too common to count: a title of common words has sets of more words, at last that of all its words."""
    ka = a.where("size(k) > 0").select(F.col("rep").alias("a"), "k", F.xxhash64("k").alias("g"))
    kb = b.where("size(k) > 0").select(F.col("rep").alias("b"), "k", F.xxhash64("k").alias("g"))
    side = lambda x, na, nb: x.select("k", "g", F.lit(na).cast("bigint").alias("na"), F.lit(nb).cast("bigint").alias("nb"))
    titles = cut(side(ka, 1, 0).unionByName(side(kb, 0, 1)).groupBy("k", "g").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")))
    total = titles.count()
    words = titles.select("g", "na", "nb", F.explode("k").alias("w"))
    counts = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("m")).withColumn("n", F.col("m")))

    @F.pandas_udf("array<bigint>")
    def made(s: pd.Series) -> pd.Series:
        return s.map(lambda r: word_sets([e["w"] for e in r], [e["m"] for e in r], total, sets, expected))

    top = hot_split_lookup(words, counts, ["w"], "n").groupBy("g", "na", "nb").agg(F.array_sort(F.collect_list(F.struct("w", "m"))).alias("r"))
    keys = cut(top.select("g", "na", "nb", F.explode(made("r")).alias("h")))
    left = keys.where("na > 0").select("h", F.col("g").alias("ga"), "na")
    right = keys.where("nb > 0").select("h", F.col("g").alias("gb"), "nb")
    linked = cut(left.join(right, "h").groupBy("ga", "gb", "na", "nb").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= meet).drop("met"))
    # titles back to classes: a title of very many classes is sent by broadcast
    near_a = hot_split_lookup(ka.select("a", F.col("g").alias("ga")), linked.select("ga", "gb", "na"), ["ga"], "na").select("a", "gb")
    weights = cut(linked.groupBy("gb").agg(F.sum("na").alias("n"), F.first("nb").alias("nb")))
    near_b = cut(hot_split_lookup(kb.select("b", F.col("g").alias("gb")), weights, ["gb"], "nb"))
    by_words = hot_split_lookup(near_a, near_b, ["gb"], "n").select("a", "b")
    by_doi = a.where("d IS NOT NULL").select(F.col("rep").alias("a"), "d").join(b.where("d IS NOT NULL").select(F.col("rep").alias("b"), "d"), "d").select("a", "b")
    return by_words.unionByName(by_doi).distinct()


def votes(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b and one column of -1, 0, 1 per labelling function."""
    left = a.select(F.col("rep").alias("a"), *[F.col(c).alias(f"a_{c}") for c in a.columns if c != "rep"])
    right = b.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "rep"])
    p = pairs.join(left, "a").join(right, "b")

    def agree(x: Column, y: Column) -> Column:
        return F.when(x.isNull() | y.isNull(), NONE).when(x == y, MATCH).otherwise(DIFFER)

    shorter = F.least(F.length("a_t"), F.length("b_t"))
    p = staged(p, {
        "hold": F.size(F.array_intersect("a_w", "b_w")) / F.greatest(F.least(F.size("a_w"), F.size("b_w")), F.lit(1)),
        "least": F.least(F.size("a_w"), F.size("b_w")),
        "over": F.least(F.size(F.array_except("a_k", "b_k")), F.size(F.array_except("b_k", "a_k"))),
        "near": F.when(shorter >= 30, 1 - F.levenshtein(F.substring(F.col("a_t"), F.lit(1), shorter), F.substring(F.col("b_t"), F.lit(1), shorter)) / shorter),
    })
    usable = F.col("least") >= 5
    # by definition an erratum, a reply, another part is no match of its work, whatever the votes: no candidate
    p = p.where(~(usable & (F.col("a_kind") != F.col("b_kind"))))
    columns = {
        "identifier": agree(F.col("a_d"), F.col("b_d")),
        "words": F.when(~usable, NONE).when(F.col("hold") >= 0.68, MATCH).when(F.col("hold") < 0.62, DIFFER).otherwise(NONE),
        "letters": F.when(F.col("near").isNull() | ~usable, NONE).when(F.col("near") >= 0.8, MATCH).when(F.col("near") < 0.7, DIFFER).otherwise(NONE),
        "nuclide": F.when((F.size("a_nuclides") < 1) | (F.size("b_nuclides") < 1), NONE).when(F.arrays_overlap("a_nuclides", "b_nuclides"), MATCH).otherwise(DIFFER),
        # words that the sources know, on either side: the titles differ in more than slips and length
        "leftover": F.when(~usable, NONE).when(F.col("over") > 0, DIFFER).otherwise(MATCH),
        "journal": agree(F.col("a_j"), F.col("b_j")),
        "year": agree(F.col("a_yr"), F.col("b_yr")),
        "pages": F.when(F.col("a_pages").isNull() | F.col("b_pages").isNull(), NONE).when(F.col("a_pages") == F.col("b_pages"), MATCH).when(F.abs(F.col("a_pages") - F.col("b_pages")) <= 1, NONE).otherwise(DIFFER),
    }
    return staged(p.select("a", "b", *[c for c in p.columns if c not in ("a", "b")]), {n: columns[n].cast("int") for n in FUNCTIONS}).select("a", "b", *FUNCTIONS)


#: What is believed of a vote before any data: chances of (differ, abstain, match) in matches and in others.
BELIEF = {n: ((0.06, 0.24, 0.7), (0.6, 0.35, 0.05)) for n in FUNCTIONS} | {"identifier": ((0.05, 0.4, 0.55), (0.5, 0.48, 0.02))}


def fit(patterns: np.ndarray, counts: np.ndarray, names: tuple[str, ...] = FUNCTIONS, rounds: int = 60, strength: float = 0.02, joint: float = 0.03) -> np.ndarray:
    """Posterior of a match for each pattern (rows of -1, 0, 1).

    First fit: functions independent given the class. Pairs whose votes carry more than `joint` nats about each
    other within the classes are then modelled jointly, and the model is fitted again."""
    if not len(patterns):
        return np.zeros(0)
    v = patterns + 1
    total = counts.sum()
    base = [np.array(BELIEF[n]) for n in names]
    score = sum(np.where(v[:, j] == 1, 0.0, np.log(base[j][0][v[:, j]] / base[j][1][v[:, j]])) for j in range(len(names)))
    post = 1 / (1 + np.exp(-np.clip(score - 2, -50, 50)))

    def em(cliques: list[tuple[int, ...]], post: np.ndarray) -> np.ndarray:
        # abstentions say nothing: a clique is split by which of its functions vote, and each part has the chances
        # of its votes alone
        parts = []
        for c in cliques:
            for k in range(1, 2 ** len(c)):
                sub = tuple(j for i, j in enumerate(c) if k >> i & 1)
                rows = np.all([(v[:, j] != 1) == (j in sub) for j in c], axis=0)
                code = sum((v[:, j] // 2) * 2**i for i, j in enumerate(sub))
                priors = []
                for y in (0, 1):
                    t = np.ones(1)
                    for j in sub:
                        q = base[j][y][[0, 2]] / base[j][y][[0, 2]].sum()
                        t = (q[:, None] * t[None, :]).ravel()
                    priors.append(t)
                parts.append((rows, code[rows], priors))
        for _ in range(rounds):
            w = (counts * post, counts * (1 - post))
            pi = np.clip((w[0].sum() + 1) / (total + 2), 1e-9, 1 - 1e-9)
            log = [np.full(len(v), np.log(pi)), np.full(len(v), np.log(1 - pi))]
            for rows, code, priors in parts:
                for y in (0, 1):
                    pseudo = (5 + strength * w[y].sum()) * priors[y]
                    n = np.bincount(code, w[y][rows], len(pseudo)) + pseudo
                    log[y][rows] += np.log(n / n.sum())[code]
            new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -60, 60)))
            if np.abs(new - post).max() < 1e-7:
                return new
            post = new
        return post

    post = em([(j,) for j in range(len(names))], post)
    gain = []
    for a, b in combinations(range(len(names)), 2):
        info = 0.0
        for w in (counts * post, counts * (1 - post)):
            t = np.bincount(v[:, a] * 3 + v[:, b], w, 9).reshape(3, 3) + 1e-9
            t /= t.sum()
            info += w.sum() / total * (t * np.log(t / (t.sum(1, keepdims=True) * t.sum(0, keepdims=True)))).sum()
        gain.append((info, a, b))
    cliques, used = [], set()
    for info, a, b in sorted(gain, reverse=True):
        if info > joint and not {a, b} & used:
            cliques.append((a, b))
            used |= {a, b}
    return em(cliques + [(j,) for j in range(len(names)) if j not in used], post)


def link(a_df: DataFrame, b_df: DataFrame, a: dict[str, str | None], b: dict[str, str | None]) -> DataFrame:
    """(a key, b key, confidence) of all pairs with a confidence over one half. a, b: names of the columns key,
    title, doi, source, pages, year."""
    names = ("title", "doi", "source", "pages", "year")
    pa, pb = known_words(*(cut(profiles(df, c["key"], *[c[n] for n in names])) for df, c in ((a_df, a), (b_df, b))))
    v = cut(votes(candidates(pa, pb), pa, pb))
    h = v.groupBy(*FUNCTIONS).count().collect()  # at most 3^9 rows
    patterns = np.array([[r[n] for n in FUNCTIONS] for r in h], dtype=int).reshape(-1, len(FUNCTIONS))
    post = fit(patterns, np.array([r["count"] for r in h], dtype=float))
    spark = a_df.sparkSession
    model = spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, post, strict=True) if x > 0.5], ", ".join(f"{n} int" for n in FUNCTIONS) + ", confidence double")
    pairs = cut(v.join(F.broadcast(model), list(FUNCTIONS)).select("a", "b", "confidence"))  # the model: at most 3^9 rows

    def members(df: DataFrame, c: dict, side: str) -> tuple[DataFrame, DataFrame]:
        """(id, g) of the records, and g, side, n of their classes."""
        cols = [df[c["title"]], df[c["doi"]], df[c["source"]], df[c["pages"]].cast("int"), df[c["year"]].cast("int") if c["year"] else F.lit(None).cast("int")]
        g = F.xxhash64(F.to_json(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(cols)]), {"ignoreNullFields": "false"}))
        t = df.select(F.col(c["key"]).alias("id"), g.alias("g"))
        return t, t.groupBy("g").agg(F.min("id").alias(side), F.count(F.lit(1)).alias("n"))

    # a class with very many records is sent to them by broadcast
    rows, classes = members(a_df, a, "a")
    of_a = cut(classes.join(pairs.groupBy("a").agg(F.collect_list(F.struct("b", "confidence")).alias("to")), "a").select("g", "n", "to"))
    linked = hot_split_lookup(rows, of_a, ["g"], "n").select(F.col("id").alias("a_id"), F.inline("to"))
    rows, classes = members(b_df, b, "b")
    of_b = hot_split_lookup(rows, cut(classes.join(pairs.select("b").distinct(), "b")), ["g"], "n").select("b", F.col("id").alias("b_id"))
    return linked.join(of_b, "b").select(F.col("a_id").cast("bigint").alias(a["key"]), F.col("b_id").cast("bigint").alias(b["key"]), "confidence")
