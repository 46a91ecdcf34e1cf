"""Repair text from scanned pages: running headers, page numbers, words broken over lines, misread characters.

Lines are labelled header, page number, body, or break (a body line that begins a paragraph) by a linear-chain
conditional model over layout features, decoded by Viterbi. It is trained on texts of the corpus that hold no line
break, put together as paragraphs, wrapped at random widths and given headers and page numbers of many styles: a
bounded sample of `sample` texts. Body lines are then joined into paragraphs, which begin at breaks; a word broken
at a line end is joined if the corpus knows the whole word, or does not know the hyphenated one. A token is misread
if the corpus does not know it but knows a word, or it makes a number, with characters that scans confuse with its
own; it is written as that word or number.

Words are counted and the sample is drawn over distinct texts. Words that scans confuse with each other form a
class; what the executors get are the classes that make up at least `rate` of all word occurrences (so at most 1/rate
classes), and of each the words of at least a hundredth of its occurrences (so at most a hundred). In rarer classes
no misreading is told.

Cases: null and blank texts have no noise; a text of one line has neither headers nor page numbers; repeated
deliveries of an item count once; very long texts and words are handled whole; an empty corpus knows no words and
gives page numbers and headers only; empty tables give none.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.session import cut, ship

BODY, HEADER, PAGE, BREAK = 0, 1, 2, 3
_BREAK = re.compile(r"\r\n|\r|\n")
_HYPHENS = "-­¬‐‑"
_EDGE = ".,;:()[]\"'“”‘’!?"

# Characters and groups of them that scans confuse, brought to common components.
_SAME = str.maketrans({"1": "i", "l": "i", "|": "i", "!": "i", "0": "o", "5": "s", "9": "g", "q": "g", "6": "b", "8": "b", "h": "b", "e": "c", "t": "f", "n": "ri", "m": "rri", "d": "ci", "u": "ii", "w": "vv"})
_TO_DIGIT = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "b": "6"})


def components_column(c: Column) -> Column:
    """components() as an expression."""
    t = F.translate(F.lower(c), *("".join(chr(k) if x == 0 else v for k, v in _SAME.items() if len(v) == 1) for x in (0, 1)))
    for k, v in _SAME.items():
        if len(v) > 1:
            t = F.replace(t, F.lit(chr(k)), F.lit(v))
    return t


@lru_cache(maxsize=200_000)
def components(word: str) -> str:
    """What a scan sees of a word: confusable characters and groups become the same."""
    return word.lower().translate(_SAME)


_NUMBER_LIKE = re.compile(r"(?=.*\d)(?=.*[A-Za-z])[0-9OolISBZ.,–-]+")


#: Shares of a class's occurrences from which a word of it is known: in texts without line breaks, and in scans where
#: there are no others.
KNOWN, SCANNED = 0.01, 0.05


class Words:
    """Words the corpus knows, and their components."""

    def __init__(self, counts: list[tuple[str, int, int]], total: int | None = None):
        """counts: (word, occurrences in texts without line breaks, in all); total: those of all words without line
        breaks. Of words that look alike, only those that hold a fair share of the occurrences are known; the others
        are taken for misreadings of them. Texts with line breaks only count where there are no others: their headers
        and slips are not the corpus's words."""
        held: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for w, one, every in counts:
            m = held[components(w)]
            m[0], m[1] = m[0] + one, m[1] + every
        self.known = set()
        scanned_only = not any(m[0] for m in held.values())
        often = 1e-3 * (sum(one for _, one, _ in counts) if total is None else total)  # common labels; rarer ones are misread numbers
        top: dict[str, tuple[int, str]] = {}
        for w, one, every in counts:
            k = components(w)
            m = held[k]
            if _NUMBER_LIKE.fullmatch(w) and one < often:
                continue
            if one >= KNOWN * m[0] > 0 or (scanned_only and every >= SCANNED * m[1]):
                self.known.add(w)
                top[k] = max(top.get(k, (-1, "")), (one if one else every, w))
        self.lower = {w.lower() for w in self.known}
        self.seen = {k: w for k, (_, w) in top.items()}
        self.memo: dict[str, int] = {}
        self.sorts: dict[str, tuple[str, bool, bool, bool]] = {}

    def knows(self, w: str) -> bool:
        return w in self.known or w.lower() in self.lower

    def any_misread(self, tokens: list[str]) -> bool:
        """Whether any token of a text is misread; each token is judged once per process."""
        memo = self.memo
        for i, t in enumerate(tokens):
            m = memo.get(t)
            if m is None:
                w = t.strip(_EDGE)
                m = 0
                if w and not w.isdigit() and not self.knows(w):
                    m = 2 if re.fullmatch(r"[0-9OolISBZ.,–-]+", w) else int(self.misread(w))
                if len(memo) >= 300_000:
                    memo.clear()
                memo[t] = m
            if m == 1 or m == 2 and self.misread(t.strip(_EDGE), tokens[i - 1].strip(_EDGE) if i else ""):
                return True
        return False

    def sort(self, t: str) -> tuple[str, bool, bool, bool]:
        """(bare token, has letters, known, looks like a known one), judged once per process."""
        s = self.sorts.get(t)
        if s is None:
            w = t.strip(_EDGE)
            k = bool(w) and self.knows(w)
            s = (w, any(map(str.isalpha, w)), k, k or components(w) in self.seen)
            if len(self.sorts) >= 300_000:
                self.sorts.clear()
            self.sorts[t] = s
        return s

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "sorts": {}}

    def corrected(self, t: str, before: str) -> str:
        """A token as it was meant: itself, unless it is misread."""
        if self.memo.get(t) == 0:  # judged by any_misread
            return t
        w = t.strip(_EDGE)
        if not self.misread(w, before.strip(_EDGE)):
            return t
        word = self.seen.get(components(w))
        if re.fullmatch(r"[0-9OolISBZ.,–-]+", w) and re.search(r"\d", w):
            word = w.translate(_TO_DIGIT)
        elif word is None:
            return t
        elif w[0].isupper() and w[1:].upper() == w[1:] and any(map(str.isalpha, w[1:])):
            word = word.upper()
        elif w[0].isupper():
            word = word[0].upper() + word[1:]
        at = t.index(w)
        return t[:at] + word + t[at + len(w) :]

    def misread(self, w: str, before: str = "") -> bool:
        if not w or w.isdigit() or self.knows(w):
            return False
        number = w.translate(_TO_DIGIT)
        if re.fullmatch(r"[0-9OolISBZ.,–-]+", w) and re.search("[A-Za-z]", w) and re.fullmatch(r"\d+(?:[.,]\d+)?(?:[–-]\d+(?:[.,]\d+)?)?", number):
            return before.lower().rstrip(".") not in ("supplement", "table", "fig", "figure", "section", "scheme", "part")
        return bool(re.search(r"[^\W\d_]|\d", w)) and len(w) > 1 and not re.fullmatch(r"[\d.,/–-]+", w) and components(w) in self.seen


# ---- line model -------------------------------------------------------------------------------------------------

_ROMAN = re.compile(r"[ivxlc]+", re.I)
_NUMBERED = re.compile(r"\W*(?:p(?:p|g|age|ages)?\b\.?|seite|s\.)?\W*(?:[A-Z]?\d{1,4}|[ivxlc]{1,6})\W*(?:(?:of|/|von)\W*\d{1,4}\W*)?", re.I)


_MARKS = (("|", re.compile(r" \| |^\||\|$"), "bar"), (" / ", re.compile(" / "), "slash"), ("–", re.compile(" – "), "dash"), ("—", re.compile(" — "), "dash"), ("•", re.compile(" • "), "dash"), ("·", re.compile(" · "), "dash"), (": ", re.compile(r"\w: "), "colon"), ("-", re.compile(r"\b[a-z]{3,}-\d{1,3}\b"), "mass"), ("(", re.compile(r"\d\(\d+\)"), "issue"))
_YEAR = re.compile(r"\(?(?:19|20)\d\d\)?")
_PAGES = re.compile(r"\d+[–-]\d+$")
_CITED = re.compile(r"\bet al\b|\bvol\b\.?|\bno\.", re.I)
_SHORT = re.compile(r"\b[A-Z][a-z]{1,5}\.")


def line_features(lines: list[str], words: Words, gaps: list[bool] | None = None) -> list[list[str]]:
    """Layout features of each line, as names; of the words only whether they are known enters. gaps: whether a blank
    line lies before."""
    stripped = [x.strip() for x in lines]
    width = max(map(len, stripped), default=0) or 1
    n = len(stripped)
    gaps = gaps or [False] * n
    spaced = sum(gaps) > 0.6 * n  # a blank line between all lines says nothing
    deep = [len(x) - len(y) > 1 and x[:1].isspace() for x, y in zip(lines, (x.lstrip() for x in lines), strict=True)]
    out = []
    for i, s in enumerate(stripped):
        letters = sum(map(str.isalpha, s))
        upper = sum(map(str.isupper, s)) / letters if letters else 0.0
        digits = sum(map(str.isdigit, s)) / (len(s) or 1)
        tokens = s.split()
        alpha = known = caps = unknown = unknown_caps = 0
        for t in tokens:
            w, has, k, looks = words.sort(t)
            if has:
                alpha += 1
                known += k
                cap = w[0].isupper()
                caps += cap
                if not looks:
                    unknown += 1
                    unknown_caps += cap
        share = known / alpha if alpha else 0.0
        before = stripped[i - 1] if i else ""
        after = stripped[i + 1] if i + 1 < n else ""
        few = min(2, unknown)
        place = "first" if i == 0 else "last" if i == n - 1 else "inside"
        f = ["bias", f"known{int(share * 4)}", f"upper{int(upper * 4)}", f"digits{min(4, int(digits * 8))}", f"rel{int(4 * len(s) / width)}", f"tokens{min(len(tokens), 6)}", place, f"unknown{min(4, unknown)}", f"unknown-caps{min(3, unknown_caps)}", f"caps{int(4 * caps / alpha) if alpha else 0}"]
        if len(s) < 24 and _NUMBERED.fullmatch(s) and (digits or letters):
            f.append("numbered")
            f.append("roman" if _ROMAN.fullmatch(s) else "arabic")
        for c, mark, name in _MARKS:
            if c in s and mark.search(s):
                f.append(name)
                f.append(f"{name}-unknown{few}")
        if digits and _YEAR.search(s):
            f.append("year")
        if digits and s[-1].isdigit() and _PAGES.search(s):
            f.append("page-range")
        low = s.lower()
        if ("et al" in low or "vol" in low or "no." in low) and _CITED.search(s):
            f.append("citation")
            f.append(f"citation-unknown{few}")
        if s.count(".") >= 2 and len(_SHORT.findall(s)) >= 2:
            f.append("abbreviations")
        head = s[:1]
        f.append("low-start" if head.islower() else "cap-start" if head.isupper() else "other-start")
        f.append("end-point" if s.endswith((".", "!", "?")) else "end-break" if s and s[-1] in _HYPHENS else "end-open")
        goes_on = after[:1].islower()
        f.append("goes-on" if goes_on else "new-after")
        open_before = bool(before) and not before.endswith((".", "!", "?"))
        f.append("open-before" if open_before else "closed-before")
        if i:
            two = stripped[i - 2] if i > 1 else ""
            low = s[:1].islower()
            # paragraphs begin after a blank line, indented, or after a line cut short, and where a sentence ends
            if gaps[i]:
                f.append(f"gap-{spaced}-{low}-{open_before}")
                f.append(f"gap-{spaced}-{low}-{open_before}-{not two.endswith(('.', '!', '?'))}")
            elif gaps[i - 1]:
                f.append(f"gap-above-{low}-{open_before}")
            if deep[i] and not deep[i - 1]:
                f.append(f"indented-{low}-{open_before}")
            if not low and not open_before and len(before) < 0.8 * width:
                f.append(f"after-short{int(5 * len(before) / width)}")
        if goes_on and before and share < 0.6 and not before.endswith("."):
            f.append("interrupts")
        if goes_on and open_before and not s.endswith((".", "!", "?", ",")):
            f.append(f"amid-unknown{min(3, unknown)}-{place}")
        out.append(f)
    return out


class LineModel:
    """Linear-chain model: weights of (feature, state) and (state, next state)."""

    def __init__(self) -> None:
        self.w: dict[str, list[float]] = {}
        self.t = np.zeros((5, 4))  # row 4: start

    def decode(self, feats: list[list[str]]) -> list[int]:
        get = self.w.get
        t0, t1, t2, t3, start = self.t.tolist()
        s0, s1, s2, s3 = start
        back = []
        for i, f in enumerate(feats):
            e0 = e1 = e2 = e3 = 0.0
            for x in f:
                v = get(x)
                if v is not None:
                    e0 += v[0]
                    e1 += v[1]
                    e2 += v[2]
                    e3 += v[3]
            if i:
                n = []
                for k in (0, 1, 2, 3):
                    best, at = s0 + t0[k], 0
                    if (x := s1 + t1[k]) > best:
                        best, at = x, 1
                    if (x := s2 + t2[k]) > best:
                        best, at = x, 2
                    if (x := s3 + t3[k]) > best:
                        best, at = x, 3
                    n.append((best, at))
                back.append((n[0][1], n[1][1], n[2][1], n[3][1]))
                s0, s1, s2, s3 = n[0][0], n[1][0], n[2][0], n[3][0]
            s0, s1, s2, s3 = s0 + e0, s1 + e1, s2 + e2, s3 + e3
        y = max((0, 1, 2, 3), key=(s0, s1, s2, s3).__getitem__)
        path = [y]
        for b in reversed(back):
            y = b[y]
            path.append(y)
        return path[::-1]

    def fit(self, data: list[tuple[list[list[str]], list[int]]], epochs: int = 4) -> LineModel:
        """Averaged perceptron on whole sequences."""
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(4))
        tt, steps = np.zeros((5, 4)), 0
        last: dict[str, int] = defaultdict(int)
        rng = random.Random(5)
        for _ in range(epochs):
            rng.shuffle(data)
            for feats, gold in data:
                steps += 1
                got = self.decode(feats)
                if got != gold:
                    for f, a, b in zip(feats, gold, got, strict=True):
                        if a != b:
                            for x in f:
                                v = self.w.setdefault(x, [0.0, 0.0, 0.0, 0.0])
                                total[x] += np.array(v) * (steps - last[x])
                                last[x] = steps
                                v[a] += 1
                                v[b] -= 1
                    for (a1, a2), (b1, b2) in zip(zip([4, *gold], gold, strict=False), zip([4, *got], got, strict=False), strict=True):
                        self.t[a1, a2] += 1
                        self.t[b1, b2] -= 1
                tt += self.t
        for x, v in self.w.items():
            total[x] += np.array(v) * (steps - last[x])
        self.w = {x: (v / max(1, steps)).tolist() for x, v in total.items()}
        self.t = tt / max(1, steps)
        return self


def _header(rng: random.Random, words: list[str], proper: list[str]) -> str:
    """A running header in one of many common styles, of words of the corpus and made-up names."""
    name = lambda: "".join(rng.choice(["bel", "kor", "min", "tas", "ven", "dor", "lu", "ra", "so"]) for _ in range(rng.randint(2, 3))).capitalize()
    some = lambda n: [rng.choice(words) for _ in range(n)] if words else [name() for _ in range(n)]
    vol, page, year = rng.randint(1, 99), rng.randint(1, 900), rng.randint(1960, 2025)
    journal = f"{rng.choice(['Journal', 'Annals', 'Letters', 'Reviews', 'Bulletin', 'Acta'])} of {name()} {rng.choice(['Science', 'Methods', 'Practice', 'Research'])}"
    short = " ".join(f"{w[:rng.randint(2, 5)]}." for w in journal.replace(" of", "").split())
    title = " ".join(some(rng.randint(1, 3)))
    caps = proper or [name()]
    element = f"{rng.choice(words) if words else name()}-{rng.randint(4, 250)}"
    styles = [
        lambda: f"{journal.upper()}  |  VOL. {vol}", lambda: f"{short} {vol} ({year}) {page}–{page + 9}", lambda: f"{short} {vol}({rng.randint(1, 12)}), {page}–{page + 9} ({year})",
        lambda: f"{name()} et al.: {title}", lambda: f"{name()} group et al.: {element} on {name()} {rng.choice('ABXZ')}-{rng.randint(1, 9)}", lambda: f"{element} on {name()} {rng.randint(1, 99)} / {short} {vol}",
        lambda: f"{element} on {name()} {rng.choice('ABXZ')}{rng.randint(1, 99)}".upper(), lambda: f"{title.title()} — {name()}", lambda: f"Chapter {rng.randint(1, 20)}. {title.title()}", lambda: f"{journal}, {year}", lambda: title.upper(),
        lambda: f"{name()} and {name()}", lambda: f"{journal} {vol} ({year})", lambda: f"{journal}, {year}, {vol}({rng.randint(1, 12)})", lambda: f"{name()} group et al.: {element} on {rng.choice(caps)} {rng.choice(caps)}", lambda: f"{element} on {rng.choice(caps)} / {short} {vol}",
    ]
    return rng.choice(styles)()


def _page(rng: random.Random) -> str:
    n, roman = rng.randint(1, 999), rng.choice(["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "xi", "xii", "xiv", "xvi", "xx"])
    return rng.choice([f"- {n} -", f"p. {n}", f"{n} |", f"| {n}", f"[{n}]", f"— {n} —", f"{n}", f"{n}", f"S{n % 90}", roman, roman, f"Page {n % 40} of {n % 40 + 9}", f"Page {n}", f"({n})"])


def _slips(rng: random.Random, s: str) -> str:
    swaps = [("e", "c"), ("l", "1"), ("o", "0"), ("m", "rn"), ("d", "cl"), ("s", "5"), ("g", "9"), ("t", "f"), ("h", "b"), ("i", "1"), ("n", "ri")]
    for _ in range(rng.choice([0, 0, 1, 2])):
        a, b = rng.choice(swaps)
        at = [i for i, c in enumerate(s) if c == a]
        if at:
            i = rng.choice(at)
            s = s[:i] + b + s[i + 1 :]
    return s


def _wrapped(rng: random.Random, text: str, width: int) -> list[str]:
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            if len(w) > 6 and rng.random() < 0.15:
                k = rng.randint(2, len(w) - 3)
                lines.append(f"{line} {w[:k]}{rng.choice(_HYPHENS)}")
                line = w[k:]
            else:
                lines.append(line)
                line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


def train_lines(texts: list[str], words: Words, seed: int = 3) -> LineModel:
    """Fit the line model on clean texts: one to three as the paragraphs of a page, which blank lines, indents or the
    short line before tell apart; wrapped and given noise."""
    rng = random.Random(seed)
    pool = sorted(w for w in words.known if w.isalpha() and w.islower() and len(w) > 3)
    proper = sorted(w for w in words.known if w[:1].isupper() and w.lower() not in words.known)
    texts = [t for t in texts if len(t.split()) >= 8]
    data, at = [], 0
    while at < len(texts):
        page = texts[at : at + rng.choice([1, 1, 1, 2, 2, 3])]
        at += len(page)
        width, style = rng.randint(34, 82), rng.choice(["blank", "blank", "indent", "short"])
        rows: list[tuple[str, int, bool]] = []  # line, label, blank line before
        for k, t in enumerate(page):
            body = [(_slips(rng, x), BODY, False) for x in _wrapped(rng, t, width)]
            new = BREAK if k else BODY
            body[0] = (("    " if style == "indent" else "") + body[0][0], new, bool(k) and style == "blank")
            rows += body
        if len(rows) > 1:
            inserts = ([(_header(rng, pool, proper), HEADER)] if rng.random() < 0.4 else []) + ([(_page(rng), PAGE)] if rng.random() < 0.4 else [])
            rng.shuffle(inserts)
            spaced = rng.random() < 0.25  # blank lines about page ends
            where = rng.randint(1, len(rows) - 1)
            together = rng.random() < 0.5
            for x, y in inserts:
                i = where if together else rng.randint(1, len(rows) - 1)
                rows.insert(i, (x, y, spaced))
                if spaced and i + 1 < len(rows):
                    rows[i + 1] = (*rows[i + 1][:2], True)
            if rng.random() < 0.1:  # a blank line inside a paragraph
                i = rng.randint(1, len(rows) - 1)
                if rows[i][1] == BODY and rows[i][0][:1].islower():
                    rows[i] = (*rows[i][:2], True)
            if rng.random() < 0.05:
                rows = [(x, y, True) for x, y, _ in rows]
        lines = [x + rng.choice(["", "", "", " "]) for x, _, _ in rows]
        data.append((line_features(lines, words, [g for _, _, g in rows]), [y for _, y, _ in rows]))
    return LineModel().fit(data)


# ---- repair -----------------------------------------------------------------------------------------------------


def _joined(end: str, x: str, words: Words) -> tuple[str, bool]:
    """(text, whether a word was broken) of a body line after the text so far."""
    broken = len(end) > 1 and end[-1] in _HYPHENS and end[-2].isalpha()
    if not broken or not x:
        return f"{end} {x}" if end and x else end or x, False
    if x[0].isalpha():
        left, right = end[:-1].rsplit(None, 1)[-1].lstrip(_EDGE), x.split(None, 1)[0].rstrip(_EDGE)
        whole, compound = left + right, f"{left}-{right}"
        if words.knows(whole) or not words.knows(compound) and (components(whole) in words.seen or components(compound) not in words.seen):
            return end[:-1] + x, True
    return end + x, False


def _as_meant(text: str, words: Words) -> str:
    before = ""

    def one(m: re.Match) -> str:
        nonlocal before
        t, before = words.corrected(m[0], before), m[0]
        return t

    return re.sub(r"\S+", one, text)


def repair(text: str, words: Words, model: LineModel, write: bool = True) -> tuple[str, set[str]]:
    """(paragraphs, kinds of noise found). write=False leaves misread words as they are."""
    noise: set[str] = set()
    if "\n" not in text and "\r" not in text:
        out = text.strip()
    else:
        filled, gaps, gap = [], [], False
        for x in _BREAK.split(text):
            if x.strip():
                filled.append(x)
                gaps.append(gap)
            gap = not x.strip()
        labels = model.decode(line_features(filled, words, gaps)) if len(filled) > 1 else [BODY] * len(filled)
        noise |= {("header" if y == HEADER else "page_no") for y in labels if y in (HEADER, PAGE)}
        parts: list[str] = []
        for x, y in zip(filled, labels, strict=True):
            if y in (HEADER, PAGE):
                continue
            if y == BREAK or not parts:
                parts.append(x.strip())
                continue
            parts[-1], was = _joined(parts[-1], x.strip(), words)
            if was:
                noise.add("hyphenation")
        out = "\n\n".join(parts)
    if words.any_misread(out.split()):
        noise.add("misread")
        out = _as_meant(out, words) if write else out
    return out, noise


def word_counts(texts: DataFrame, text: str, rate: float = 1e-6) -> tuple[list[tuple[str, int, int]], int]:
    """((word, count in texts without line breaks, count in all), count of all words without line breaks) of the known
    words: in classes that make up at least `rate` of all occurrences, the words of a share of KNOWN or more, so at
    most 1/rate times 1/KNOWN, whatever the size of the corpus. Counts cover all texts given; pass distinct ones, so
    that a text that is copied often does not make its slips known words."""
    edge = F.lit(_EDGE)
    one = (~F.contains(text, F.lit("\n"))).cast("int").alias("one")
    w = texts.where(F.col(text).isNotNull()).select(one, F.explode(F.split(F.translate(text, "\r\n\t", "   "), " ")).alias("w"))
    c = w.groupBy(F.trim("w", edge).alias("w")).agg(F.sum("one").alias("one"), F.count(F.lit(1)).alias("n")).where(r"w RLIKE '[^0-9.,/–-]'")
    c = cut(c.withColumn("k", components_column(F.col("w"))))
    ones, total = c.agg(F.coalesce(F.sum("one"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = c.groupBy("k").agg(F.sum("one").alias("ones"), F.sum("n").alias("all")).where(F.col("all") >= rate * total)
    fair = (F.col("one") > 0) & (F.col("one") >= KNOWN * F.col("ones")) if ones else F.col("n") >= SCANNED * F.col("all")
    return [(r["w"], r["one"], r["n"]) for r in c.join(classes, "k").where(fair).select("w", "one", "n").collect()], ones


def fit(texts: DataFrame, text: str, sample: int = 3000) -> tuple[Words, LineModel]:
    """Known words (all distinct texts) and line model (a bounded sample of `sample` distinct texts without line
    breaks, the smallest by hash)."""
    texts = cut(texts.where(F.col(text).isNotNull()).select(text).distinct())
    words = Words(*word_counts(texts, text))
    # only texts below a bound on the hash, some more than are wanted, leave the executors
    plain = texts.where(~F.col(text).rlike(r"[\r\n]") & (F.length(text) > 60)).select(text, F.xxhash64(text).alias("h"))
    share = min(1.0, 1.5 * (sample + 30) / max(1, plain.count()))
    drawn = plain.where(F.col("h") <= min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)).collect()
    return words, train_lines([r[text] for r in sorted(drawn, key=lambda r: (r["h"], r[text]))[:sample]], words)


def clean(df: DataFrame, key: str, text: str, words: Words, model: LineModel, paragraphs: bool = True) -> DataFrame:
    """key, paragraph STRING (null unless asked for), noise ARRAY<STRING>. Narrow."""
    shared = df.sparkSession.sparkContext.broadcast((words, model))  # bounded, see word_counts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = shared.value
        short: dict[str, tuple[str, set[str]]] = {}  # section headings come again and again

        def one(t: str | None) -> tuple[str | None, set[str]]:
            if t is None:
                return None, set()
            if len(t) > 40:
                return repair(t, w, m, paragraphs)
            r = short.get(t)
            if r is None:
                r = repair(t, w, m, paragraphs)
                if len(short) < 50_000:
                    short[t] = r
            return r

        for b in batches:
            done = [one(t) for t in b.column(1).to_pylist()]
            p = pa.array([p for p, _ in done], pa.string()) if paragraphs else pa.nulls(len(done), pa.string())
            yield pa.record_batch([b.column(0), p, pa.array([sorted(n) for _, n in done], pa.list_(pa.string()))], names=["k", "paragraph", "noise"])

    ship(df.sparkSession)
    return df.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k bigint, paragraph string, noise array<string>").withColumnRenamed("k", key)


def found(texts: DataFrame, key: str = "item_id", text: str = "source_section") -> DataFrame:
    words, model = fit(texts, text)
    c = clean(texts.where(F.trim(text) != ""), key, text, words, model, paragraphs=False)
    return c.select(key, F.explode("noise").alias("noise")).distinct()
