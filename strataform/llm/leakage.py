"""Find held-out evaluation items in corpus documents, whole or in part.

Spaced-seed hashing: fixed masks pick some of the next tokens and ignore the others, so that changed words
between them do no harm; the picked tokens' signatures (consonants and digits, in any order) survive small
slips. One pass over the corpus hashes every place of every document and keeps the hashes that pass a bitmap of
the test items' hashes (at most 2^27 bits, whatever the number of items); what is kept is joined with the test
items' hashes. Around the hits, test item and document are aligned word by word, tolerating slips, changed,
missing and added words; an item is leaked where one or two aligned pieces of at least `min_piece` words hold at
least `share` of its words.

Hashes that several items hold come from phrases they share and are no evidence, so they are left out; but an
item half of whose words (`share`) lie in such phrases is a version of others (a copy, an excerpt) and keeps all
of its hashes. What counts as shared is counted over all items at once, so the answer does not depend on how they
are spread over tasks.

Scale: documents without a hit end in the first pass; nothing of them is shuffled or sent to the driver. The
others are written once to the checkpoint folder, and their hits meet the test hashes in a shuffle join whose hot
hashes go by broadcast (hot_split_lookup). An item that a third of all documents leak is sent by broadcast, too.

Cases: null, empty and blank texts leak nothing; items shorter than `min_piece` words are never found; test items
of equal text are all reported; repeated documents are reported each under its own id, and rows of one id
together; very long documents are scanned whole; ties between pieces go to the earlier one; an empty test table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.operators.skew import hot_split_lookup
from strataform.session import cut, ship

#: Fixed masks over token positions: 1 takes part in the hash, 0 is ignored.
MASKS = ("11111", "110111", "1101011", "1010111", "11001101", "100101011")
_WORD = re.compile(r"[^\W_]+")
_M = (1 << 64) - 1


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Signatures(dict):
    """token -> 64-bit hash of its digits and its set of consonants (all letters if it has none)."""

    def __missing__(self, t: str) -> int:
        import xxhash

        s = "".join(c for c in t if c.isdigit()) + "".join(sorted({c for c in t if c not in "aeiouy" and not c.isdigit()})) or t
        h = xxhash.xxh64_intdigest(s)
        if len(self) < 500_000:
            self[t] = h
        return h


def seeds(sig: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(mask, hashes at every position) of each mask over a token signature array."""
    for m, mask in enumerate(MASKS):
        n = len(sig) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, 0x9E3779B97F4A7C15 * (m + 1) & _M, dtype=np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ sig[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
        yield mask, h


_slip_cache: dict[tuple[str, str], bool] = {}


def same_word(a: str, b: str) -> bool:
    """Equal, or equal but for a slip: one edit (or swap of neighbours) per four letters; numbers must be equal."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    hit = _slip_cache.get((a, b))
    if hit is None:
        limit = max(1, max(len(a), len(b)) // 4)
        old2: list[int] = []
        old = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = min(d, old2[j - 2] + 1)
                new.append(d)
            old2, old = old, new
        hit = old[-1] <= limit
        if len(_slip_cache) < 300_000:
            _slip_cache[a, b] = hit
    return hit


def equal_words(item: list[str], doc: list[str]) -> np.ndarray:
    """Matrix of item words by document words: the same but for a slip. Each pair of different words is compared
    once, and only if it begins or ends alike."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(doc):
        places[w].append(j)
    first: dict[str, list[str]] = defaultdict(list)
    last: dict[str, list[str]] = defaultdict(list)
    for v in places:
        first[v[0]].append(v)
        last[v[-1]].append(v)
    eq = np.zeros((len(item), len(doc)), dtype=bool)
    rows: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(item):
        rows[w].append(i)
    for w, at in rows.items():
        cols = list(places.get(w, ()))
        for v in first.get(w[0], []):
            if v != w and same_word(w, v):
                cols += places[v]
        for v in last.get(w[-1], []):
            if v[0] != w[0] and same_word(w, v):
                cols += places[v]
        for i in at:
            eq[i, cols] = True
    return eq


def best_piece(eq: np.ndarray, free: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of free item words with document words: (score, item from, item to, matched words).
    A match counts 1, a changed, missing or added word -1. Rows are filled at once: a gap along the row is a
    running maximum."""
    m, n = eq.shape
    at = np.arange(n + 1)
    h = np.zeros((m + 1, n + 1), dtype=np.int32)
    for i in range(m):
        if free[i]:
            row = h[i + 1]
            row[1:] = np.where(eq[i], h[i, :-1] + 1, np.maximum(h[i, :-1], h[i, 1:]) - 1)
            np.maximum(row, 0, out=row)
            np.subtract(np.maximum.accumulate(row + at), at, out=row)
    top = int(h.argmax())
    i, j = divmod(top, n + 1)
    score, end, matched = int(h[i, j]), i, 0
    while h[i, j] > 0:
        if eq[i - 1, j - 1] and h[i, j] == h[i - 1, j - 1] + 1:
            i, j, matched = i - 1, j - 1, matched + 1
        elif h[i, j] == h[i - 1, j - 1] - 1:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, i, end, matched


def held(item: list[str], doc: list[str], diagonals: list[int], share: float, min_piece: int) -> tuple[float, int]:
    """(share of the item's words held by one or two pieces of the document, pieces); (0, 0) if it is no leak.
    diagonals: position in the document less position in the item, of each hit."""
    n = len(item)
    if n < min_piece:
        return 0.0, 0
    # windows of the document that the item may cover, merged where they overlap
    spans: list[list[int]] = []
    for d in sorted(set(diagonals)):
        a, b = max(0, d - 8), min(len(doc), d + n + 8)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        elif a < b:
            spans.append([a, b])
    # a piece covers fewer than 2n words of the document, so blocks that overlap by so many lose none
    blocks = [(x, min(b, x + 16 * n)) for a, b in spans for x in range(a, max(a + 1, b - 2 * n), 14 * n)]
    grid = lru_cache(maxsize=256)(lambda k: equal_words(item, doc[slice(*blocks[k])]))
    free, covered, pieces = np.ones(n, dtype=bool), 0, 0
    while blocks and pieces < 2:
        _, a, b, matched = max((best_piece(grid(k), free) for k in range(len(blocks))), key=lambda x: x[0])
        if b - a < min_piece or matched < 0.6 * (b - a):
            break
        free[a:b] = False
        covered += b - a
        pieces += 1
        if pieces == 1 and not covered >= share * n and n - covered < min_piece:
            break
    return (covered / n, pieces) if covered >= share * n else (0.0, 0)


def item_seeds(tests: DataFrame, share: float) -> DataFrame:
    """h, item, pos: the hashes that the test items are looked for by; all of those that no other item holds, and
    all others of items of whose words a share of at least `share` lies in phrases of others, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.leakage import _Signatures, seeds, tokens

        sig = _Signatures()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.array([sig[x] for x in tokens(t)], dtype=np.uint64)
                for mask, h in seeds(s):
                    k = len(h)
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(k, i, np.int64)), pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, len(mask), np.int32)), pa.array(np.full(k, len(s), np.int32))], names=["h", "item", "pos", "span", "n"])

    all_seeds = tests.mapInArrow(run, "h bigint, item bigint, pos int, span int, n int")
    owners = all_seeds.groupBy("h").agg((F.min("item") != F.max("item")).alias("shared"))
    # the item's words that lie under a shared hash
    s = cut(all_seeds.join(owners, "h"))
    under = s.where("shared").select("item", "n", F.explode(F.expr("sequence(pos, pos + span - 1)")).alias("word"))
    versions = under.groupBy("item").agg((F.countDistinct("word") >= F.lit(share) * F.max("n")).alias("version")).where("version").select("item")
    own = s.where("NOT shared").unionByName(s.where("shared").join(versions, "item", "left_semi"), allowMissingColumns=True)
    return own.select("h", "item", "pos")


def seed_bitmap(lookup: DataFrame, most: int = 27) -> tuple[np.ndarray, int]:
    """(bytes, bits used of a hash): a bitmap of the hashes, some 256 bits each, at most 2^most bits (16 MB)."""
    n = lookup.count()
    bits = min(most, max(15, int(n * 256).bit_length()))
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))  # bit x of the map is position x + 1
    parts = lookup.select((low + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = np.zeros((1 << bits) // 8 + 4096, dtype=np.uint8)
    for r in parts.toLocalIterator():  # at most 2^most bits in all
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["m"])] = np.frombuffer(r["m"], dtype=np.uint8)
    return out, bits


def scan(docs: DataFrame, tests: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, share: float = 0.5, min_piece: int = 8, bits: int = 27, hits_needed: int = 4) -> DataFrame:
    """doc_id, item_id, held DOUBLE (share of the item's words), pieces INT. bits: most bits of the bitmap that hashes
    pass before the join; it changes the work, never the rows. hits_needed: hashes that document and item must share
    to be aligned; half an item of 50 words has some 130 of them, and with four words in ten changed some 10."""
    spark = docs.sparkSession
    ship(spark)
    items = tests.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("words")).where("item IS NOT NULL AND words IS NOT NULL")
    lookup = cut(item_seeds(items, share).groupBy("h").agg(F.collect_list(F.struct("item", "pos")).alias("owners")))
    shared = spark.sparkContext.broadcast(seed_bitmap(lookup, bits))  # at most 2^bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.leakage import _Signatures, seeds, tokens

        (bitmap, used), sig = shared.value, _Signatures()
        low = np.uint64((1 << used) - 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                # the documents' words one after the other; hits that run over an end are taken out
                words = [tokens(t) for t in b.column(1).to_pylist()]
                ends = np.cumsum([len(w) for w in words])
                s = np.fromiter((sig[x] for w in words for x in w), np.uint64, int(ends[-1]))
                found = []
                for mask, h in seeds(s):
                    x = h & low
                    at = np.flatnonzero((bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                    at = at[at + len(mask) <= ends[np.searchsorted(ends, at, "right")]]
                    found.append((at, h[at]))
                if not found:
                    continue
                at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                owner = np.searchsorted(ends, at, "right")
                order = np.argsort(owner, kind="stable")
                owner, at, h = owner[order], at[order], h[order]
                docs_hit, n = np.unique(owner, return_counts=True)
                if len(docs_hit):
                    begin = np.where(owner > 0, ends[owner - 1], 0)
                    pairs = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((at - begin).astype(np.int32))], ["h", "p"])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pairs)
                    keep = pa.array(docs_hit)
                    yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep), lists], names=["d", "t", "hits"])

    src = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).where("t IS NOT NULL")
    near = cut(src.mapInArrow(run, "d bigint, t string, hits array<struct<h:bigint,p:int>>"))
    hits = near.select("d", F.inline("hits"))
    weighed = cut(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(lookup, "h"))
    met = hot_split_lookup(hits, weighed, ["h"], "n").select("d", "p", F.inline("owners"))
    pairs = cut(met.groupBy("d", "item").agg(F.collect_set(F.col("p") - F.col("pos")).alias("diagonals"), F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= hits_needed).drop("hits"))
    texts = cut(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(items, "item"))
    both = hot_split_lookup(pairs, texts, ["item"], "n").join(near.select("d", "t"), "d")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.leakage import held, tokens

        for b in batches:
            rows = []
            for d, i, g, x, t in zip(*[b.column(c).to_pylist() for c in ("d", "item", "diagonals", "words", "t")], strict=True):
                part, pieces = held(tokens(x), tokens(t), g, share, min_piece)
                if pieces:
                    rows.append((d, i, part, pieces))
            if rows:
                yield pa.record_batch([pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["d", "item", "held", "pieces"])

    out = both.select("d", "item", "diagonals", "words", "t").mapInArrow(align, "d bigint, item bigint, held double, pieces int")
    best = out.groupBy("d", "item").agg(F.max(F.struct("held", "pieces")).alias("m"))
    return best.select(F.col("d").alias(doc_id), F.col("item").alias(item_id), "m.held", "m.pieces")
