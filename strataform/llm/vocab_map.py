"""Map freely typed values to the entries of a reference list; values without an entry are reported as 0.

SQL only. Values are made distinct, cleaned of strengths, grades and remarks, and joined by equality (words of kinds
whose entries are words by their stem, too). What is left goes through a partition-based pigeonhole join: a
reference string of length L that allows k edits is cut into k+1 segments; any string within k edits holds one of
them unchanged, near its place, so an equality join on positional substrings finds every candidate, and levenshtein
verifies it. Values that stay unmatched are found by anti-joins.

What is another name, though much like a listed one, and what a slip, is told from all values: one particular slip
is rare, so a string that comes up in at least a tenth (two slips and more: a hundredth) as many values as the entry
it is near, and five times at the least, is a name of its own. So are strings that are near no entry and come up
five times. These names compete with the entries for the slips, through the same pigeonhole join. Lists of other
names may be given, too; none is built in.

Chemical formulas with digits are only met by equality, as each letter and digit of them counts; in all strings
numbers must be equal.

Cases: null and blank values, and values that are exactly a term, give no row; placeholders and unlisted values
give 0; ties between terms go to the smallest edit distance, then the smallest term_id; repeated deliveries of an
item give one row; very long values and very long terms are compared like others (more and longer segments); empty
tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.functions.lookalikes import INVISIBLE, fold_pairs
from strataform.functions.sqlrun import run_sql
from strataform.session import cut

#: Kinds whose entries are words: inflected forms and single words of a value count.
WORDS = ("role", "type")
# Symbols of the chemical elements.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
)
_FORMULA = rf"^(?=.*[0-9])(?:(?:{'|'.join(sorted(ELEMENTS.split(), key=lambda e: -len(e)))})[0-9]*|[(){{}}\[\]·.])+$"

_R = "r'{}'".format
_NUM = r"[0-9]+(?:[.,][0-9]+)?"
_STRENGTH = rf"{_NUM} ?-?(?:mol/l|mmol/l|mol l-1|mol dm-3|molar|mm|m|n|wt ?%|vol ?%|%)"
_LEAD = rf"^(?:(?:{_STRENGTH}|conc|concentrated|dil|dilute|diluted|aq|hot|cold|warm|boiling|fresh|freshly prepared|ultrapure|pure|distilled|dry|anhydrous|glacial|fuming|chilled|degassed|purified|high-purity|trace grade|reagent grade|analytical grade)(?:[. -]+))+(?=.)"
_GRADE = rf"(?:analytical grade|trace grade|reagent grade|hplc grade|grade|reagent|reag|p\. ?a|pa|puriss|suprapur|aq|aqueous|soln|sol|solution|techn|conc|dil|stock solution|{_STRENGTH})"
_TAIL = rf"(?:[ ,]+{_GRADE}\.?|[ ,]*\({_GRADE}\.?\)|[ ]*\(\?\)|[ .,;:!?]+)+$"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lower(v: str) -> str:
    a, b = fold_pairs()
    fr, to = a + "₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹_" + INVISIBLE, b + "01234567890123456789 "
    return f"trim(regexp_replace(lower(translate({v}, {_q(fr)}, {_q(to)})), {_R(r'[\s\p{Z}]+')}, ' '))"


def _key(v: str) -> str:
    return f"regexp_replace({v}, {_R(r'[^\p{L}\p{N}]+')}, '')"


def _stem(t: str) -> str:
    """A word without its endings of number, tense and derivation (English), of which three letters stay."""
    for ending in ("s", "ing|ed|er|e|ic", "ation|ion|e", "e"):
        t = f"regexp_replace({t}, {_R(f'^(.{{3,}}?)(?:{ending})$')}, '$1')"
    t = f"regexp_replace(regexp_replace({t}, {_R('lut$')}, 'lv'), {_R('rpt$')}, 'rb')"  # solution, solve; absorption, absorb
    return f"regexp_replace({t}, {_R('([bdgmnprt])[bdgmnprt]$')}, '$1')"


_IS_WORD = "kind IN ({})".format(", ".join(map("'{}'".format, WORDS)))


def references(spark: SparkSession, vocab: DataFrame, other: dict[str, str] | None = None) -> DataFrame:
    """kind, term_id (0: another name, if a list of such is given), ref (as text), k (letters and digits only), formula
    (whether it is a chemical formula with digits)."""
    rows = [(k, 0, n.strip()) for k, names in (other or {}).items() for n in names.split(",")]
    others = spark.createDataFrame(rows, "kind string, term_id int, t string")
    return run_sql(
        spark,
        f"""WITH t AS (SELECT kind, term_id, explode(array_union(array(term), coalesce(aliases, array()))) AS t FROM @vocab UNION ALL SELECT kind, term_id, t FROM @others),
            r AS (SELECT kind, term_id, {_lower('t')} AS ref, translate(t, '₀₁₂₃₄₅₆₇₈₉', '0123456789') RLIKE {_R(_FORMULA)} AS formula FROM t WHERE t IS NOT NULL),
            k AS (SELECT *, {_key('ref')} AS k FROM r)
            SELECT kind, k, min(ref) AS ref, coalesce(min(nullif(term_id, 0)), 0) AS term_id, bool_or(formula) AS formula FROM k WHERE k <> '' GROUP BY kind, k""",
        vocab=vocab,
        others=others,
    )


def variants(spark: SparkSession, values: DataFrame) -> DataFrame:
    """kind, val, ref-like text w, key k and level (0 as typed, 1 stripped, 2 single word)."""
    lead = lambda v: f"trim(regexp_replace({v}, {_R(_LEAD)}, ''))"
    strip = lambda v: f"trim(regexp_replace({lead(v)}, {_R(_TAIL)}, ''))"
    once = lambda v: f"trim(regexp_replace({v}, {_R(_TAIL[:-2] + '$')}, ''))"
    return run_sql(
        spark,
        f"""WITH c AS (SELECT kind, val, {_lower('val')} AS c0 FROM @values),
            s AS (SELECT kind, val, c0, s1, trim(regexp_replace(s1, {_R(r' ?\((?:[^()]|\([^()]*\))*\)$')}, '')) AS o1, regexp_extract(s1, {_R(r'^.+? \((.+)\)$')}, 1) AS i1
                  FROM (SELECT *, inline(array(struct({strip(strip('c0'))} AS s1))) FROM c)),
            w AS (SELECT kind, val, inline(concat(
                  array(struct(c0 AS w, 0 AS level), struct({lead('c0')} AS w, 1 AS level), struct({once(lead('c0'))} AS w, 1 AS level), struct(s1 AS w, 1 AS level), struct(o1 AS w, 1 AS level), struct(i1 AS w, 1 AS level)),
                  transform(filter(array(s1, o1), x -> x RLIKE {_R(r'^[^,]+, .+$')}), x -> struct(regexp_replace(x, {_R(r'^([^,]+), (.+)$')}, '$2 $1') AS w, 1 AS level)),
                  CASE WHEN {_IS_WORD} THEN transform(filter(split(c0, {_R(r'[^\p{L}\p{N}.]+')}), x -> length(x) > 2), x -> struct(x AS w, 2 AS level)) ELSE array() END)) FROM s)
            SELECT kind, val, k, min(w) AS w, min(level) AS level FROM (SELECT kind, val, w, level, {_key('w')} AS k FROM w) WHERE k <> '' GROUP BY kind, val, k""",
        values=values,
    )


def _best(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """One term per value: smallest distance; words only where no longer part fits; listed before other names."""
    return run_sql(
        spark,
        "SELECT kind, val, min(struct(d + 0.5 * CAST(level = 2 AS INT) AS d, term_id = 0 AS other, term_id)).term_id AS term_id FROM @hits GROUP BY kind, val",
        hits=hits,
    )


#: Slips allowed by length of the reference: up to 3 letters none, then 1, from 7 letters 2, from 12 letters 3.
_SLIPS = "CASE WHEN L <= 3 THEN 0 WHEN L <= 6 THEN 1 WHEN L <= 11 THEN 2 ELSE 3 END"


def near(spark: SparkSession, keys: DataFrame, refs: DataFrame) -> DataFrame:
    """kind, k, rk, term_id, d: keys (kind, k) and references (kind, k, term_id, formula) within the slips allowed. One
    swap of neighbours may count as one slip, so that the edits are one more than the slips.

    References of one length are cut alike; a key is cut at the places of every length of references that it may be
    near. The lengths go by broadcast: strings of S characters in all have at most sqrt(2 S) different lengths."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, at = "(L div (E + 1) + CAST(i >= E + 1 - L % (E + 1) AS INT))", "(1 + i * (L div (E + 1)) + greatest(0, i - (E + 1 - L % (E + 1))))"
    segs = run_sql(
        spark,
        f"""WITH l AS (SELECT kind, term_id, k, length(k) AS L FROM @r WHERE NOT formula), e AS (SELECT *, {_SLIPS} + 1 AS E FROM l WHERE L > 3), s AS (SELECT *, explode(sequence(0, E)) AS i FROM e)
            SELECT kind, term_id, k AS rk, L, E, i, substr(k, {at}, {size}) AS seg FROM s""",
        r=refs,
    )
    pairs = run_sql(
        spark,
        f"""WITH n AS (SELECT /*+ REPARTITION({tasks}) */ kind, k, length(k) AS n FROM @k WHERE length(k) > 2), a AS (SELECT *, explode(sequence(greatest(4, n - 4), n + 4)) AS L FROM n),
            x AS (SELECT DISTINCT kind, L, {_SLIPS} + 1 AS E FROM (SELECT kind, length(k) AS L FROM @r WHERE NOT formula) WHERE L > 3), l AS (SELECT /*+ BROADCAST(x) */ a.*, x.E FROM a JOIN x ON a.kind = x.kind AND a.L = x.L WHERE abs(n - a.L) <= x.E),
            s AS (SELECT *, explode(sequence(0, E)) AS i FROM l),
            o AS (SELECT *, {size} AS len, {at} AS p, greatest(-i, n - L - (E - i)) AS lo, least(i, n - L + (E - i)) AS hi FROM s),
            b AS (SELECT DISTINCT kind, k, L, i, substr(k, p + o, len) AS seg FROM (SELECT *, explode(sequence(lo, hi)) AS o FROM o WHERE lo <= hi) WHERE p + o >= 1 AND p + o + len - 1 <= n)
            SELECT DISTINCT b.kind, b.k, s.rk, s.term_id, s.E FROM b JOIN @s s ON b.kind = s.kind AND b.L = s.L AND b.i = s.i AND b.seg = s.seg
            WHERE regexp_replace(b.k, '[^0-9]', '') = regexp_replace(s.rk, '[^0-9]', '')""",
        k=keys,
        s=segs,
        r=refs,
    )
    swap = "concat(substr(k, 1, i - 1), substr(k, i + 1, 1), substr(k, i, 1), substr(k, i + 2))"
    swapped = f"least(lev, 1 + array_min(transform(sequence(1, greatest(length(k) - 1, 1)), i -> levenshtein({swap}, rk))))"
    return run_sql(
        spark,
        f"""WITH e AS (SELECT *, inline(array(struct(levenshtein(k, rk, E) AS lev))) FROM @p), d AS (SELECT *, inline(array(struct(CASE WHEN lev <= 1 THEN lev ELSE {swapped} END AS d))) FROM e WHERE lev >= 0)
            SELECT kind, k, rk, term_id, d FROM d WHERE d < E""",
        p=pairs,
    )


def match(spark: SparkSession, values: DataFrame, refs: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """kind, val, term_id of the distinct values (kind, val, n: how often); 0 where no entry is meant. A string that
    comes up `least` times, and `share` as often as the entry it is one slip from (share * share: more slips), is a
    name of its own."""
    v = cut(variants(spark, values))
    stems = run_sql(spark, f"SELECT kind, stem, min(term_id) AS term_id FROM (SELECT kind, term_id, {_stem('k')} AS stem FROM @r WHERE {_IS_WORD} AND term_id > 0) GROUP BY kind, stem HAVING count(DISTINCT term_id) = 1", r=refs)
    exact = cut(run_sql(
        spark,
        f"""SELECT v.kind, v.val, v.k, v.level, 0 AS d, r.term_id FROM @v v JOIN @r r ON v.kind = r.kind AND v.k = r.k
            UNION ALL SELECT v.kind, v.val, v.k, v.level, 0 AS d, s.term_id FROM (SELECT *, {_stem('k')} AS stem FROM @v WHERE {_IS_WORD}) v JOIN @s s ON v.kind = s.kind AND v.stem = s.stem""",
        v=v,
        r=refs,
        s=stems,
    ))
    done = cut(_best(spark, run_sql(spark, "SELECT * FROM @e WHERE level < 2", e=exact)))
    rest = cut(run_sql(spark, "SELECT v.*, c.n FROM @v v JOIN @c c ON v.kind = c.kind AND v.val = c.val LEFT ANTI JOIN @d d ON v.kind = d.kind AND v.val = d.val", v=v, c=values, d=done))
    words = run_sql(spark, "SELECT e.kind, e.val, e.level, e.d, e.term_id FROM @e e LEFT ANTI JOIN @d d ON e.kind = d.kind AND e.val = d.val WHERE e.level = 2", e=exact, d=done)
    short = abbreviations(spark, rest, refs)
    # entries, and forms of them that came up, meet what is left
    known = run_sql(spark, "SELECT kind, k, max(term_id) AS term_id, bool_or(formula) AS formula FROM (SELECT kind, k, term_id, formula FROM @r UNION ALL SELECT kind, k, term_id, false FROM @e) GROUP BY kind, k", r=refs, e=exact)
    keys = cut(run_sql(spark, "SELECT kind, k, sum(n) AS n, min(level) < 2 AS whole FROM @v GROUP BY kind, k", v=rest))
    hits = cut(run_sql(
        spark,
        """WITH t AS (SELECT d.kind, d.term_id, sum(c.n) AS t FROM @d d JOIN @c c ON d.kind = c.kind AND d.val = c.val GROUP BY d.kind, d.term_id),
           b AS (SELECT kind, k, min(struct(d, term_id)) AS b FROM @h GROUP BY kind, k), o AS (SELECT b.kind, b.k, k.n >= {least} AND k.n >= pow({share}, least(b.b.d, 2)) * coalesce(t.t, 0) AS own
             FROM b JOIN @k k ON b.kind = k.kind AND b.k = k.k LEFT JOIN t ON b.kind = t.kind AND b.b.term_id = t.term_id)
           SELECT h.kind, h.k, h.d, h.term_id, o.own FROM @h h JOIN o ON h.kind = o.kind AND h.k = o.k""".format(least=least, share=share),
        h=near(spark, keys, known),
        k=keys,
        d=done,
        c=values,
    ))
    slips = cut(run_sql(spark, "SELECT v.kind, v.val, v.k, v.level, h.d, h.term_id FROM @v v JOIN @h h ON v.kind = h.kind AND v.k = h.k WHERE NOT h.own", v=rest, h=hits))
    first = run_sql(spark, "SELECT DISTINCT kind, val FROM (SELECT kind, val FROM @a UNION ALL SELECT kind, val FROM @b UNION ALL SELECT kind, val FROM @c)", a=short, b=words, c=slips)
    # names of their own compete for the slips
    names = cut(run_sql(
        spark,
        f"""WITH u AS (SELECT DISTINCT v.kind, v.k FROM @v v LEFT ANTI JOIN @f f ON v.kind = f.kind AND v.val = f.val WHERE v.level < 2)
            SELECT k.kind, k.k, 0 AS term_id, false AS formula FROM @k k JOIN u ON k.kind = u.kind AND k.k = u.k WHERE k.n >= {least} AND k.whole""",
        v=rest,
        f=first,
        k=keys,
    ))
    doubtful = run_sql(spark, "SELECT DISTINCT v.kind, v.k FROM @v v LEFT SEMI JOIN @s s ON v.kind = s.kind AND v.val = s.val WHERE v.level < 2", s=slips, v=rest)
    rivals = run_sql(spark, "SELECT v.kind, v.val, v.level, h.d, h.term_id FROM @v v JOIN @h h ON v.kind = h.kind AND v.k = h.k LEFT SEMI JOIN @s s ON v.kind = s.kind AND v.val = s.val", v=rest, h=near(spark, doubtful, names), s=slips)
    later = cut(_best(spark, run_sql(spark, "SELECT kind, val, level, d, term_id FROM @a UNION ALL SELECT * FROM @b UNION ALL SELECT kind, val, level, d, term_id FROM @c UNION ALL SELECT * FROM @d", a=short, b=words, c=slips, d=rivals)))
    return run_sql(
        spark,
        "SELECT * FROM @d UNION ALL SELECT * FROM @l UNION ALL SELECT DISTINCT r.kind, r.val, 0 AS term_id FROM @r r LEFT ANTI JOIN @l l ON r.kind = l.kind AND r.val = l.val UNION ALL SELECT v.kind, v.val, 0 FROM @v v LEFT ANTI JOIN @w w ON v.kind = w.kind AND v.val = w.val",
        d=done,
        l=later,
        r=rest,
        v=values,
        w=v,
    )


def abbreviations(spark: SparkSession, values: DataFrame, refs: DataFrame) -> DataFrame:
    """kind, val, level, d, term_id: one word of an entry of one or two words cut short by a point. The beginnings of the
    entries' words are segments that the short word must equal; so must the other word."""
    return run_sql(
        spark,
        f"""WITH l AS (SELECT *, {_lower('val')} AS low FROM @v WHERE level = 0),
            a AS (SELECT kind, val, level, regexp_extract(w, {_R(r'^([^ .]{3,})\.(?: ([^ .]+))?(?: of .*| step)?$')}, 1) AS p, regexp_extract(w, {_R(r'^([^ .]{3,})\. ([^ .]+)$')}, 2) AS rest, 1 AS first FROM @v
                        UNION ALL SELECT kind, val, level, regexp_extract(low, {_R(r'^[^ .]+ ([^ .]{2,})\.$')}, 1), regexp_extract(low, {_R(r'^([^ .]+) [^ .]{2,}\.$')}, 1), 2 FROM l
                        UNION ALL SELECT kind, val, 1, regexp_extract(low, {_R(r'^([^ .]{3,})\.')}, 1), '', 1 FROM l WHERE {_IS_WORD}),
            r AS (SELECT kind, term_id, k, split(ref, ' ') AS x FROM @r),
            w AS (SELECT kind, term_id, k, x[0] AS long, coalesce(get(x, 1), '') AS rest, 1 AS first FROM r WHERE size(x) <= 2
                  UNION ALL SELECT kind, term_id, k, x[1], x[0], 2 FROM r WHERE size(x) = 2),
            b AS (SELECT kind, term_id, rest, first, substr(long, 1, n) AS p FROM (SELECT *, explode(sequence(2, length(long))) AS n FROM w WHERE length(long) > 1))
            SELECT a.kind, a.val, a.level, 0 AS d, coalesce(min(nullif(b.term_id, 0)), 0) AS term_id FROM a JOIN b ON a.kind = b.kind AND a.first = b.first AND a.rest = b.rest AND a.p = b.p
            GROUP BY a.kind, a.val, a.level HAVING count(DISTINCT nullif(b.term_id, 0)) <= 1""",
        v=values,
        r=refs,
    )


def found(spark: SparkSession, columns: list[tuple[DataFrame, str, str, str]], vocab: DataFrame, other: dict[str, str] | None = None) -> DataFrame:
    """(item_id, field, term_id) of every free value. columns: (df with item_id, column, field, kind). Values that make
    up a thousandth of all go by broadcast (at most a thousand), the others by shuffle."""
    vocab = run_sql(spark, "SELECT term_id, kind, term, aliases FROM @v", v=vocab)
    parts = {f"t{chr(97 + i)}": df for i, (df, _, _, _) in enumerate(columns)}
    text = " UNION ALL ".join(f"SELECT CAST(item_id AS BIGINT) AS item_id, {_q(field)} AS field, {_q(kind)} AS kind, `{c}` AS val FROM @t{chr(97 + i)} WHERE `{c}` RLIKE {_R(r'[^\s\p{Z}]')}" for i, (_, c, field, kind) in enumerate(columns))
    every = run_sql(spark, text, **parts)
    free = run_sql(spark, "SELECT o.* FROM @o o LEFT ANTI JOIN @vocab v ON o.kind = v.kind AND o.val = v.term", vocab=vocab, o=every)
    counts = cut(run_sql(spark, "SELECT kind, val, count(*) AS n FROM @e GROUP BY kind, val", e=every))
    mapped = cut(run_sql(spark, "SELECT m.kind, m.val, m.term_id, c.n FROM @m m JOIN @c c ON m.kind = c.kind AND m.val = c.val", m=match(spark, counts, cut(references(spark, vocab, other))), c=counts))
    return run_sql(
        spark,
        """WITH hot AS (SELECT kind, val, term_id FROM @m WHERE n >= (SELECT sum(n) / 1000 FROM @m)), cold AS (SELECT kind, val, term_id FROM @m WHERE n < (SELECT sum(n) / 1000 FROM @m))
           SELECT DISTINCT item_id, field, term_id FROM (
             SELECT /*+ BROADCAST(hot) */ f.item_id, f.field, hot.term_id FROM @f f JOIN hot ON f.kind = hot.kind AND f.val = hot.val
             UNION ALL SELECT g.item_id, g.field, cold.term_id FROM (SELECT /*+ BROADCAST(hot) */ f.* FROM @f f LEFT ANTI JOIN hot ON f.kind = hot.kind AND f.val = hot.val) g JOIN cold ON g.kind = cold.kind AND g.val = cold.val)""",
        m=mapped,
        f=free,
    )
