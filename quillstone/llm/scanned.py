"""Noise in text from scanned pages: find the defects of each line, and repair the text.

Two averaged perceptrons are trained on the driver, from at most ``TRAIN_WORDS`` words of the lexicon, and
their weights travel to the tasks:

* the character editor predicts keep, replace, delete and insert for the characters of a word, and join or
  keep for a line end. It is trained on lexicon words into which look-alikes (``CONFUSIONS``) are put and
  which are cut at every place, against pairs of words that only stand side by side. It generates the edits:
  an operation is proposed where its score exceeds that of keep, and nothing else is tried;
* the line model labels each line as text, page number or running header by its shape and its position on
  the page (blank or full neighbours, first or last line, how near its number lies to the chunk's pages, how
  many letter pairs of a running head it shows). It is trained on pages composed from lexicon words.

What the models propose is then held against the definition, which only ever rejects: an edit has to turn a
word that is not in the lexicon into one that is, by one pair of ``CONFUSIONS``; a join has to give a word
of the lexicon; a page number has to lie in the chunk's pages; a running head has to be one of the paper's.
Misread letters of furniture belong to the furniture; ``misread`` is told of running text.

A lexicon of up to ``SHIPPED_WORDS`` words travels with the models. A larger one stays distributed: each chunk
asks for the words it needs (its words, their proposed edits, its joined line ends), a join gives back
those that exist, and the same reader runs with them.

Edge cases: null and blank texts have no defects and stay as they are; a chunk of an unknown paper has no
running heads; without page numbers no line is a page number; words known as they stand are never changed;
line ends of any kind are read; an empty lexicon leaves nothing to put back or to join; an empty table gives
an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import attach
from quillstone.session import cut

#: What is read -> what stands on the page.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("5", "s"), ("c", "e"), ("f", "t"), ("o", "a"), ("l", "i"), ("i", "l"), ("b", "h"), ("q", "g"),
    ("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("11", "ll"), ("m", "in"), ("h", "li"), ("n", "ri"), ("6", "b"), ("9", "g"),
    # the same letters the other way round, and digits that look like two letters
    ("e", "c"), ("t", "f"), ("a", "o"), ("h", "b"), ("g", "q"), ("d", "cl"), ("m", "rn"), ("w", "vv"), ("u", "ii"), ("in", "m"), ("li", "h"), ("ri", "n"),
    ("8", "b"), ("6", "g"), ("1", "i"),
)
#: Signs that stand for a hyphen at a line end.
HYPHENS = "-‐‑‒–¬­"
#: At most so many words of the lexicon train the models (bounded sample, in the order of their hashes).
TRAIN_WORDS = 2000
#: Up to this size a lexicon travels with the tasks, beyond it the texts are joined with it.
SHIPPED_WORDS = 200_000
_PAIRS = frozenset(CONFUSIONS)
_LONGEST_READ = max(len(r) for r, _ in CONFUSIONS)

_TOKEN = re.compile(r"[^\W_]+")
_LEAD = re.compile(r"[^\W\d_]+")
_TRAIL = re.compile(r"([^\W\d_]+)$")

KEEP, JOIN, DELETE = "keep", "join", "delete"


class AveragedPerceptron:
    """Multi-class averaged perceptron over string features; ties go to the label named first."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str], labels: Collection[str]) -> dict[str, float]:
        out = dict.fromkeys(labels, 0.0)
        for f in features:
            row = self.w.get(f)
            if row:  # a feature names its character, so it has weights for labels of that character only
                for label, weight in row.items():
                    out[label] += weight
        return out

    def learn(self, examples: list[tuple[list[str], tuple[str, ...], str]], epochs: int, seed: int, margin: float = 1.0) -> None:
        """``examples``: features, the labels that may stand there, the right one, which has to lead by ``margin``."""
        sums: dict[str, dict[str, float]] = {}
        rng, t = random.Random(seed), 1
        order = list(examples)
        for _ in range(epochs):
            rng.shuffle(order)
            wrong = 0
            for features, labels, gold in order:
                s = self.scores(features, labels)
                best = s[gold] - margin
                rival = max((x for x in labels if x != gold), key=s.__getitem__, default=None)
                if rival is not None and s[rival] > best:
                    wrong += 1
                    for f in features:
                        row, total = self.w.setdefault(f, {}), sums.setdefault(f, {})
                        for label, step in ((gold, 1.0), (rival, -1.0)):
                            row[label] = row.get(label, 0.0) + step
                            total[label] = total.get(label, 0.0) + t * step
                t += 1
            if not wrong:
                break
        for f, total in sums.items():
            self.w[f] = {label: x for label, w in self.w[f].items() if (x := round(w - total[label] / t, 4))}


def edit_labels(read: str, true: str) -> list[str]:
    """Operations on the characters of ``read`` that give ``true``."""
    if len(read) == len(true):
        return [f"replace:{x}" for x in true]
    if len(read) > len(true):
        return [f"replace:{true}", *[DELETE] * (len(read) - len(true))]
    return [f"replace:{true[0]}+insert:{true[1:]}"]


def _labels_at() -> dict[str, tuple[str, ...]]:
    out: dict[str, dict[str, None]] = {}
    for read, true in CONFUSIONS:
        for ch, label in zip(read, edit_labels(read, true)):
            out.setdefault(ch, {KEEP: None})[label] = None
    return {ch: tuple(labels) for ch, labels in out.items()}


#: The operations that may stand at a character.
LABELS_AT = _labels_at()


class CharacterEditor:
    """Proposes the edits of a word and the joins of line ends, by the scores of an averaged perceptron."""

    def __init__(self, sample: list[str], seed: int = 13):
        self.model = AveragedPerceptron()
        self._cache: dict[str, list[tuple[str, float]]] = {}
        words = sorted({w for w in sample if len(w) > 1})
        if words:
            self.model.learn(self._examples(words, random.Random(seed)), 10, seed)

    @staticmethod
    def _features(w: str, i: int) -> list[str]:
        p = f"^^^{w}$$$"
        a, b, c, d, e, f, g = p[i : i + 7]
        return [f"c{d}", f"l{c}{d}", f"r{d}{e}", f"t{c}{d}{e}", f"L{b}{c}{d}", f"R{d}{e}{f}", f"m{b}{c}{d}{e}", f"M{c}{d}{e}{f}", f"w{b}{c}{d}{e}{f}", f"W{a}{b}{c}{d}{e}{f}{g}"]

    @staticmethod
    def _join_features(left: str, right: str) -> list[str]:
        a, b = f"^^^{left}"[-4:], f"{right}$$$"[:4]
        return ["J", f"Ja{a[3]}{b[0]}", f"Jb{a[2:]}{b[0]}", f"Jc{a[3]}{b[:2]}", f"Jd{a[2:]}{b[:2]}", f"Je{a[1:]}", f"Jf{b[:3]}", f"Jg{a[1:]}{b[:1]}", f"Jh{a[3]}{b[:3]}", f"Ji{a[1:]}{b[:3]}", f"Jk{a}{b}"]

    def _examples(self, words: list[str], rng: random.Random) -> list[tuple[list[str], tuple[str, ...], str]]:
        out, known = [], frozenset(words)
        for w in words:
            for read, true in CONFUSIONS:
                labels = edit_labels(read, true)
                at = w.find(true)
                while at >= 0:
                    broken = w[:at] + read + w[at + len(true) :]
                    if broken not in known:
                        for i in range(max(at - 2, 0), min(at + len(read) + 2, len(broken))):
                            if broken[i] in LABELS_AT:
                                inside = at <= i < at + len(read)
                                out.append((self._features(broken, i), LABELS_AT[broken[i]], labels[i - at] if inside else KEEP))
                    at = w.find(true, at + 1)
            for i in range(1, len(w)):
                out.append((self._join_features(w[:i], w[i:]), (KEEP, JOIN), JOIN))
            for other in (rng.choice(words) for _ in range(3)):
                if w + other not in known:
                    out.append((self._join_features(w, other), (KEEP, JOIN), KEEP))
        return out

    def joins(self, left: str, right: str) -> bool:
        """Whether a line ending with ``left`` and a hyphen is predicted to go on with ``right`` as one word."""
        s = self.model.scores(self._join_features(left.lower(), right.lower()), (KEEP, JOIN))
        return s[JOIN] > s[KEEP]

    def proposals(self, word: str) -> list[tuple[str, float]]:
        """The words that the predicted operations make of ``word``, best first.

        An operation is predicted where it scores above keep; ``delete`` goes with the replacement before it.
        """
        w = word.lower()
        got = self._cache.get(w)
        if got is not None:
            return got
        found: dict[str, float] = {}
        gains: list[dict[str, float]] = []
        for i, ch in enumerate(w):
            labels = LABELS_AT.get(ch)
            s = self.model.scores(self._features(w, i), labels) if labels else {}
            gains.append({x: v - s[KEEP] for x, v in s.items() if v > s[KEEP]})
        for i, ops in enumerate(gains):
            for label, gain in ops.items():
                if label == DELETE:
                    continue
                put = label.removeprefix("replace:").replace("+insert:", "")
                # one character, and those after it whose deletion or replacement is predicted too
                total, j = gain, i + 1
                while True:
                    if (w[i:j], put) in _PAIRS:
                        x = w[:i] + put + w[j:]
                        found[x] = max(found.get(x, 0.0), total)
                    if j >= len(w) or j - i >= _LONGEST_READ:
                        break
                    more = {x: v for x, v in gains[j].items() if x == DELETE or ("+" not in x and (w[i : j + 1], put + x[8:]) in _PAIRS)}
                    if not more:
                        break
                    step = max(more, key=more.__getitem__)
                    put, total, j = put + ("" if step == DELETE else step[8:]), total + more[step], j + 1
        got = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        if len(self._cache) > 200_000:
            self._cache.clear()
        self._cache[w] = got
        return got

    def fix(self, word: str, words: frozenset[str]) -> str | None:
        """The best proposal that is in ``words``; none if the word is itself."""
        if word.lower() in words:
            return None
        return next((x for x, _ in self.proposals(word) if x in words), None)


_LOOKS = str.maketrans("OoQDlIiSsBZzgqb", "000011155822996")
_NUMBER = re.compile(r"[0-9OoQDlIiSsBZzgqb]+")
_PAGE_WORD = re.compile(r"p[ao0]g[ec]s?|pg|pp?", re.I)
_DECIMAL = re.compile(r"\d\.\d")
_VOLUME_WORD = re.compile(r"v[o0][l1](?:ume)?|no|pp?|p[ao0]g[ec]", re.I)


def _digits(text: str) -> int | None:
    """A number whose digits may be misread; none for what is no number or exceeds any page."""
    if not _NUMBER.fullmatch(text):
        return None
    plain = text.translate(_LOOKS).lstrip("0") or "0"
    return int(plain) if len(plain) < 19 else None  # page numbers are 64-bit integers at most


def page_number_of(line: str, first: int | None, last: int | None) -> int | None:
    """The page a line gives, if it gives nothing else and the page is one of the chunk's."""
    if first is None or last is None:
        return None
    # page word, number, "out of", total: a line of more words gives something else
    tokens = list(islice(_TOKEN.finditer(line), 6))
    if tokens and len(tokens) > 1 and _PAGE_WORD.fullmatch(tokens[0].group()):
        tokens = tokens[1:]
    if not tokens:
        return None
    n, rest = _digits(tokens[0].group()), tokens[1:]
    if n is None or not first <= n <= last:
        return None
    if rest:
        if not _NUMBER.fullmatch(rest[-1].group()):
            return None
        said = "".join(x.group() for x in rest[:-1]).lower().replace("0", "o")
        if said not in ("", "of", "outof") or (not said and "/" not in line[tokens[0].end() : rest[0].start()]):
            return None
    return n


def distance_within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    # only cells near the diagonal can hold a distance within the limit
    far = limit + 1
    prev = {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= limit else {}
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            row[j] = min(prev.get(j, far) + 1, row.get(j - 1, far) + 1, prev.get(j - 1, far) + (x != b[j - 1]))
        if min(row.values(), default=far) > limit:
            return False
        prev = row
    return prev.get(len(b), far) <= limit


def _bare(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


@lru_cache(maxsize=1 << 14)
def _pairs(text: str) -> frozenset[str]:
    return frozenset([text[i : i + 2] for i in range(len(text) - 1)])


def _slack(head: str) -> int:
    """Edits by which misread letters may change a head."""
    return len(head) // 6


def _same_head(said: str, head: str) -> bool:
    if not said or not head:
        return False
    limit = _slack(head)
    if abs(len(said) - len(head)) > limit:
        return False
    if head in said:  # only a few more characters
        return True
    # an edit touches at most two pairs of neighbours
    if len(_pairs(said) & _pairs(head)) < len(_pairs(head)) - 2 * limit:
        return False
    return distance_within(said, head, limit)


def heads_of(short_title: str | None, authors: list[str] | None, journal: str | None, abbrev: str | None) -> list[str]:
    """The running heads a paper may have, reduced to words."""
    first = next(iter(authors or []), None)
    said = [short_title, f"{first} et al." if first and first.strip() else None, journal, abbrev]
    return [h for h in dict.fromkeys(_bare(x) for x in said if x) if h]


def _beside(word: str) -> bool:
    """Whether a word may stand beside a running head: a number, perhaps misread, or what announces one."""
    if _NUMBER.fullmatch(word):
        return any(c.isdigit() for c in word) or not word.strip("OolI")
    return bool(_VOLUME_WORD.fullmatch(word))


def _shown(line: str, heads: list[str]) -> list[tuple[float, str]]:
    """For each head the share of its letter pairs that the line shows."""
    said = _bare(line)
    pairs = {said[i : i + 2] for i in range(len(said) - 1)}
    return [(len(_pairs(h) & pairs) / max(len(_pairs(h)), 1), h) for h in heads]


def _near(shown: list[tuple[float, str]]) -> list[str]:
    """The heads the line may show: an edit touches two letter pairs at most."""
    return [h for share, h in shown if share * len(_pairs(h)) >= len(_pairs(h)) - 2 * _slack(h) - 1e-9]


def _core(tokens: list[str]) -> int:
    """Length of the words of a line from the first to the last that may not stand beside a head."""
    lo, hi = 0, len(tokens)
    while lo < hi and _beside(tokens[lo]):
        lo += 1
    while lo < hi and _beside(tokens[hi - 1]):
        hi -= 1
    return sum(map(len, tokens[lo:hi])) + max(hi - lo - 1, 0)


def running_head_of(line: str, heads: list[str]) -> str | None:
    """The head that a line shows, with at most volume, year and page number besides."""
    near = _near(_shown(line, heads))
    if not near:
        return None
    words = re.sub(r"[^\w\s]", " ", line).split()
    lead = next((i for i, w in enumerate(words) if not _beside(w)), len(words))
    trail = next((i for i, w in enumerate(reversed(words)) if not _beside(w)), len(words))
    words = [w.lower() for w in words]
    ends = [0, *accumulate(len(w) + 1 for w in words)]  # with a space after each word
    for h in near:
        limit = _slack(h)
        for i in range(lead + 1):
            lo, hi = bisect_left(ends, ends[i] + len(h) + 1 - limit), bisect_right(ends, ends[i] + len(h) + 1 + limit)
            for j in range(max(lo, len(words) - trail, i + 1), min(hi, len(words) + 1)):
                if _same_head(" ".join(words[i:j]), h):
                    return h
    return None


class LineModel:
    """Labels the lines of a chunk by their shape and their position on the page."""

    LABELS = TEXT, NUMBER, HEAD = "text", "page_number", "running_header"

    def __init__(self, sample: list[str], seed: int = 17):
        self.model = AveragedPerceptron()
        rng, words, examples = random.Random(seed), sorted(set(sample)), []
        # names that no lexicon holds stand in titles and texts too
        words += ["".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(max(len(words) // 4, 300))]
        for _ in range(700):
            self._compose(rng, words, examples)
        self.model.learn(examples, 6, seed)

    @staticmethod
    def _misread(rng: random.Random, s: str) -> str:
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3, 5])):
            read, true = rng.choice(CONFUSIONS)
            at = s.lower().find(true, rng.randrange(len(s) + 1))
            if at >= 0:
                s = s[:at] + read + s[at + len(true) :]
        return s

    def _compose(self, rng: random.Random, words: list[str], examples: list) -> None:
        """A page from lexicon words with its furniture, and lines that only look like furniture."""
        some = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
        heads = list(dict.fromkeys(some(*rng.choice([(1, 2), (2, 4), (3, 9), (8, 30)])) for _ in range(rng.randint(1, 4))))
        first = int(10 ** rng.uniform(0, 4.5))
        last = first + rng.choice([0, 1, 1, 1, 2, 9])
        n = rng.randint(first, last)
        noisy = str(n)
        if rng.random() < 0.25:
            for digit, look in (("0", "O"), ("1", "l"), ("5", "S"), ("8", "B")):
                if digit in noisy and rng.random() < 0.7:
                    noisy = noisy.replace(digit, look, 1)
        page = rng.choice(["{}", "{} / {1}", "{}/{1}", "{} of {1}", "    {}", "- {} -", "– {} –", "[{}]", "| {} |", "({})", "Page {}", "page {}", "PAGE {}", "p. {}", "pp. {}", "page {} of {1}", "PAGE {} OF {1}", "page {} out of {1}", "--- {} ---"]).replace("{}", "{0}").format(noisy, last + rng.randint(0, 400))
        head = rng.choice(heads)
        head = rng.choice([head, head.upper(), head.title(), head.capitalize(), head.replace(" ", ". ") + "."])
        shown = rng.choice(["{0}", "{0}", "{0} | {1}", "{1}    {0}", "{1} {0}", "{0}    {1}", "{0}, vol. {2}, {3}", "{0}, vol. {2}, {3}    {1}", "{0} {2} ({3})", "{0} {2} ({3}) {1}", "{0} {2}, no. 4, {3}", "{0} et al."]).format(self._misread(rng, head), noisy, rng.randint(1, 99), rng.randint(1950, 2025))
        text = lambda: some(1, 14) + rng.choice(["", "", ".", ",", "-", f" {rng.randint(1, 500)}", f" at {rng.randint(1, 99)}.5 mg", f" {n} " + some(1, 4)])
        decoy = [rng.choice([str(last + rng.randint(1, 900)), f"n = {n}", f"{n}.{rng.randint(0, 9)}", f"{n} mg", f"in {n} days", rng.choice(words), f"{head} {some(3, 12)}.", f"{some(1, 3)} {head} {some(2, 9)}", f"# {some(1, 5)}"])]
        rows = [(text(), self.TEXT) for _ in range(rng.randint(1, 8))] + [(x, self.TEXT) for x in decoy if rng.random() < 0.6]
        rng.shuffle(rows)
        if shown.endswith("et al.") and "et al" not in head:
            heads.append(_bare(f"{head} et al."))
        block = rng.choice([[(page, self.NUMBER)], [(shown, self.HEAD)], [(page, self.NUMBER), (shown, self.HEAD)], [(shown, self.HEAD), (page, self.NUMBER)]])
        blank = rng.choice([[], [], [("", self.TEXT)]])
        at = rng.randint(0, len(rows))
        rows = [*rows[:at], *blank, *block, *blank, *rows[at:]]
        lines = [x for x, _ in rows]
        for i, (x, y) in enumerate(rows):
            if x:
                examples.append((self.features(lines, i, first, last, [_bare(h) for h in heads]), self.LABELS, y))

    @staticmethod
    def features(lines: list[str], i: int, first: int | None, last: int | None, heads: list[str], shown: list[tuple[float, str]] | None = None) -> list[str]:
        s = lines[i].strip()
        tokens = [m.group() for m in islice(_TOKEN.finditer(s), 8)]
        numbers = [x for x in tokens if _beside(x)]
        values = [v for v in map(_digits, numbers[:4]) if v is not None]
        where = "none" if not values else "unknown" if first is None or last is None else "in" if any(first <= v <= last for v in values) else "out"
        before = "start" if i == 0 else "blank" if not lines[i - 1].strip() else "full"
        after = "end" if i + 1 == len(lines) else "blank" if not lines[i + 1].strip() else "full"
        size, plain = len(tokens), min(len(tokens) - len(numbers), 4)
        share, head = max(_shown(s, heads) if shown is None else shown, default=(0.0, ""))
        like, extra = int(share * 8 + 1e-9), min(max(len(s) - len(head), 0) // 6, 9) if head else -1
        letters = sum(map(str.isalpha, s)) - sum(map(str.isalpha, head))
        more = max(min(letters // 3, 6), -4) if head else 9
        page = bool(tokens) and bool(_PAGE_WORD.fullmatch(tokens[0]))
        marks = f"{'/' in s}{bool(_DECIMAL.search(s))}"
        return [f"n{size}", f"p{plain}", f"np{size}{plain}{marks}", f"v{where}", f"vp{where}{plain}{page}{marks}", f"h{like}", f"he{like},{extra}", f"hn{like},{plain}", f"d{more}", f"hd{like},{more}", f"b{before}", f"a{after}", f"ba{before}{after}{where}{plain}", f"bh{before}{after}{like}", f"s{s[-1:] in '.!?:'}", f"u{s.isupper()}{like}", f"w{page}{size}"]

    def proposes(self, lines: list[str], i: int, first: int | None, last: int | None, heads: list[str], shown: list[tuple[float, str]] | None = None) -> list[str]:
        """The kinds of furniture that score above running text, best first."""
        s = self.model.scores(self.features(lines, i, first, last, heads, shown), self.LABELS)
        return sorted((x for x in (self.NUMBER, self.HEAD) if s[x] > s[self.TEXT]), key=lambda x: -s[x])


class PageReader:
    """Defects and repair of a chunk; ``words`` holds the lexicon, or the part of it the chunk may need."""

    def __init__(self, sample: list[str]):
        self.editor, self.pages = CharacterEditor(sample), LineModel(sample)

    def furniture(self, lines: list[str], tokens: list[list[str]], first: int | None, last: int | None, heads: list[str]) -> list[str | None]:
        """page_number, running_header or none for each line: what the model proposes, if the line is one by definition."""
        out: list[str | None] = []
        longest = max((len(h) + _slack(h) for h in heads), default=-1)
        for i, line in enumerate(lines):
            kind, shown = None, None
            few = len(tokens[i]) < 6
            # a line of many words that cannot show a head is no furniture, so the model need not be asked
            if tokens[i] and (few or (_core(tokens[i]) <= longest and _near(shown := _shown(line, heads)))):
                for x in self.pages.proposes(lines, i, first, last, heads, shown):
                    if page_number_of(line, first, last) is not None if x == LineModel.NUMBER else running_head_of(line, heads):
                        kind = x
                        break
            out.append(kind)
        return out

    @staticmethod
    def _line_ends(lines: list[str], kinds: list[str | None]) -> Iterator[tuple[int, int, str, str]]:
        """Lines of running text that end with a hyphen, the one each goes on in, and the letters on both sides."""
        running = [i for i, k in enumerate(kinds) if k is None and lines[i].strip()]
        for here, after in zip(running, running[1:]):
            s = lines[here].strip()
            if s[-1] in HYPHENS:
                left, right = _TRAIL.search(s[:-1].rstrip()), _LEAD.match(lines[after].strip())
                if left and right:
                    yield here, after, left.group(1).lower(), right.group().lower()

    def needed(self, text: str, first: int | None, last: int | None, heads: list[str]) -> set[str]:
        """Every word whose presence in the lexicon ``read`` and ``repair`` may ask for."""
        lines = text.split("\n")
        tokens = [_TOKEN.findall(x) for x in lines]
        asked = {x.lower() for line in tokens for x in line}
        for _, _, left, right in self._line_ends(lines, self.furniture(lines, tokens, first, last, heads)):
            asked |= {left, right, left + right}
        # repair mends joined words, and words whose neighbours were joined to them
        return asked | {y for x in list(asked) for y, _ in self.editor.proposals(x)}

    def read(self, text: str, first: int | None, last: int | None, heads: list[str], words: frozenset[str]) -> tuple[list[tuple[int, str]], list[str | None], dict[int, int]]:
        """(line, defect) pairs, furniture by line, and joins: line index -> index of the line it goes on in."""
        lines = text.split("\n")
        tokens = [_TOKEN.findall(x) for x in lines]
        kinds = self.furniture(lines, tokens, first, last, heads)
        joins: dict[int, int] = {}
        cut_ends: set[int] = set()  # lines whose last word is a fragment
        cut_starts: set[int] = set()  # lines whose first word is one
        sound = lambda w: w in words or self.editor.fix(w, words) is not None
        for here, after, left, right in self._line_ends(lines, kinds):
            if left + right in words and self.editor.joins(left, right):
                joins[here] = after
                cut_ends.add(here), cut_starts.add(after)
            elif sound(left + right) or not (sound(left) and sound(right)):
                cut_ends.add(here), cut_starts.add(after)
        found: list[tuple[int, str]] = []
        for i in range(len(lines)):
            if kinds[i]:
                found.append((i + 1, kinds[i]))
                continue
            if i in joins:
                found.append((i + 1, "hyphenation"))
            whole = tokens[i][1 if i in cut_starts else 0 : -1 if i in cut_ends else None]
            if any(self.editor.fix(t, words) for t in {x.lower() for x in whole} - words):
                found.append((i + 1, "misread"))
        return found, kinds, joins

    def _mend(self, line: str, words: frozenset[str]) -> str:
        def put(m: re.Match) -> str:
            w = m.group()
            better = self.editor.fix(w, words)
            if not better:
                return w
            return better.upper() if w.isupper() and len(w) > 2 else better.capitalize() if w[0].isupper() or (w[0] == "l" and better[0] == "i" and w[1:2].isupper()) else better

        return _TOKEN.sub(put, line)

    def repair(self, text: str, first: int | None, last: int | None, heads: list[str], words: frozenset[str]) -> str:
        """The text as continuous paragraphs, without furniture."""
        lines = text.split("\n")
        _, kinds, joins = self.read(text, first, last, heads, words)
        width = max((len(x.strip()) for i, x in enumerate(lines) if kinds[i] is None), default=0)
        paragraphs: list[str] = []
        cur, open_join, gap = "", False, False
        previous = ""
        for i, line in enumerate(lines):
            s = line.strip()
            if kinds[i]:
                continue
            if not s:
                gap = True
                continue
            ended = previous[-1:] in ".!?:" and not open_join
            heading = s.startswith("#") or previous.startswith("#")
            short = len(previous) < width - 25 or width > 160
            if cur and not open_join and (heading or (ended and (gap or short))):
                paragraphs.append(cur)
                cur = ""
            if i in joins:
                body = s[:-1].rstrip()
            else:
                body = s
            cur = cur + body if open_join or not cur else f"{cur} {body}"
            open_join, gap, previous = i in joins, False, s
        if cur:
            paragraphs.append(cur)
        return "\n\n".join(self._mend(p, words) for p in paragraphs)


def _words(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("word IS NOT NULL").select(F.lower("word").alias("word")).distinct()


@lru_cache(maxsize=4)
def page_reader(sample: tuple[str, ...]) -> PageReader:
    """The reader trained on these words."""
    return PageReader(list(sample))


def trained(lexicon: DataFrame) -> PageReader:
    rows = _words(lexicon).orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS).collect()
    return page_reader(tuple(sorted(r["word"] for r in rows)))


def _with_heads(chunks: DataFrame, papers: DataFrame, journals: DataFrame) -> DataFrame:
    """The chunks with what may run at the head of their pages. One paper may hold any share of the chunks."""
    rows = chunks.select("chunk_key", "paper_stem", "page_first", "page_last", "text").where(F.col("text").rlike(r"(?U)\S"))
    names = journals.groupBy("journal_id").agg(F.first("journal").alias("journal"), F.first("abbrev").alias("abbrev"))
    info = papers.where("paper_stem IS NOT NULL").groupBy("paper_stem").agg(F.first(F.struct("short_title", "authors", "journal_id")).alias("p"))
    info = info.select("paper_stem", "p.*").join(names, "journal_id", "left").drop("journal_id")
    counted = cut(rows.groupBy("paper_stem").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = cut(counted.join(info, "paper_stem", "left").select("paper_stem", "short_title", "authors", "journal", "abbrev", "n"))
    return attach(rows, known, ["paper_stem"], "n", total, "left")


_INPUT = ["page_first", "page_last", "text", "short_title", "authors", "journal", "abbrev"]


def _columns(batch: pa.RecordBatch, start: int) -> Iterator[tuple]:
    """page_first, page_last, text and heads of the rows, from the column at ``start``."""
    for first, last, text, *head in zip(*(batch.column(start + i).to_pylist() for i in range(len(_INPUT)))):
        yield text, first, last, heads_of(*head)


def _read_all(chunks: DataFrame, papers: DataFrame, journals: DataFrame, lexicon: DataFrame, use: Callable[[PageReader, list, list[tuple], list[frozenset[str]]], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """``use(reader, keys, rows, words)`` over all chunks with text; ``words`` as far as each row may need them."""
    reader = trained(lexicon)
    rows = _with_heads(chunks, papers, journals)
    shipped = [r["word"] for r in _words(lexicon).limit(SHIPPED_WORDS + 1).collect()]
    if len(shipped) <= SHIPPED_WORDS:
        every = frozenset(shipped)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(use(reader, batch.column(0).to_pylist(), list(_columns(batch, 1)), [every] * batch.num_rows), names=names)

        return rows.select("chunk_key", *_INPUT).mapInArrow(run, schema)

    numbered = cut(rows.select(F.monotonically_increasing_id().alias("row"), "chunk_key", *_INPUT))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), _columns(batch, 1)):
                asked = sorted(reader.needed(*x))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(asked), pa.int64()), pa.array(asked, pa.string())], names=["row", "word"])

    asked = numbered.select("row", *_INPUT).mapInArrow(ask, "row bigint, word string")
    known = asked.join(_words(lexicon), "word").groupBy("row").agg(F.collect_list("word").alias("words"))

    def run_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [frozenset(w or ()) for w in batch.column(len(_INPUT) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(use(reader, batch.column(0).to_pylist(), list(_columns(batch, 1)), words), names=names)

    return numbered.join(known, "row", "left").select("chunk_key", *_INPUT, "words").mapInArrow(run_with, schema)


def line_defects(chunks: DataFrame, papers: DataFrame, journals: DataFrame, lexicon: DataFrame) -> DataFrame:
    """chunk_key, line_no (from 1), defect: one row for each defect of a line."""

    def use(reader: PageReader, keys: list, rows: list[tuple], words: list[frozenset[str]]) -> list[pa.Array]:
        found = [(key, *x) for key, row, known in zip(keys, rows, words) for x in reader.read(*row, known)[0]]
        return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string()))]

    return _read_all(chunks, papers, journals, lexicon, use, "chunk_key bigint, line_no int, defect string", ["chunk_key", "line_no", "defect"])


def repaired(chunks: DataFrame, papers: DataFrame, journals: DataFrame, lexicon: DataFrame) -> DataFrame:
    """chunk_key, repaired_text of every chunk; null and blank texts stay as they are."""

    def use(reader: PageReader, keys: list, rows: list[tuple], words: list[frozenset[str]]) -> list[pa.Array]:
        return [pa.array(keys, pa.int64()), pa.array([reader.repair(*row, known) for row, known in zip(rows, words)], pa.string())]

    full = _read_all(chunks, papers, journals, lexicon, use, "chunk_key bigint, repaired_text string", ["chunk_key", "repaired_text"])
    rest = chunks.where(F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S")).select("chunk_key", F.col("text").alias("repaired_text"))
    return full.unionByName(rest)
