"""Template residue, filler and error pages: a regularised linear classifier of segments.

A text is cut into segments at line ends and sentence ends.  A segment's features are
hashed n-grams of three readings of its bytes (lower case with digits as one; without
blanks and with every kind of delimiter as one; shapes of letters, digits and signs),
its length, the text's length and whether it stands as the title.  Two weight vectors of
an L2-regularised logistic regression are fitted on weak labels: response statuses and
failure outputs for error pages, template forms and repeated or pseudo-Latin text for
placeholders and filler.  The classifier decides: a text is residue if one of its
segments is a placeholder or filler, or if most of it, by length, is an error page.
Recall and precision are reported on repositories that the fit hasn't seen.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

#: Documents the classifier is fitted and reported on, at most, and further ones of at most ``SHORT`` characters, among which error pages are; drawn by a hash of the id.
SAMPLE_DOCS, SAMPLE_SHORT = 8_000, 10_000
#: Plain segments the fit uses, at most; those with unusual signs and short ones all count, each once.
SAMPLE_SEGMENTS = 12_000
#: Hashed n-grams: (reading, length); bits of a hash.
GRAMS = ((0, 5), (0, 9), (1, 7), (1, 11), (2, 6))
BITS = 17
TABLE = (len(GRAMS) + 1) << BITS
EPOCHS, RATE, L2 = 20, 0.05, 1e-6
#: Smoothing of n-gram counts, and the weight that every scaled n-gram starts with.
SMOOTH, START = 2.0, 0.05
#: A known residue segment weighs as much as so many others.
POSITIVE_WEIGHT = 8.0
#: Mean log-ratio of a segment's n-grams from which the first pass takes an unlabelled segment for residue, and its passes.
EXPAND_AT, PASSES = 1.2, 5
#: Log-odds from which a segment is template residue or part of an error page, and the share of a text's bytes that the latter must make up.
TEMPLATE_AT, ERROR_AT, ERROR_SHARE = -2.0, -0.5, 0.5
SLICE_BYTES = 1 << 19

# Weak labels.  Fixed values: response statuses and failure outputs at the head of a text.
_STATUS = re.compile(
    r"\A(?:\s|<[^<>]*>)*(?:HTTP/[\d.]+ )?[45]\d\d\b|\A\s*\{\s*\"(?:status|code)\":\s*\"?[45]\d\d\b|\A\s*<error>|\A\s*(?i:error|fatal|critical)[: ]|\A\s*(?:[\w$]+\.)+\w*(?:Exception|Error)\b|\A\s*Traceback \("
    r"|\A\s*<noscript>|\A\s*Loading\b[^\n]{0,5}\n[^\n]{1,200}\n[^\n]{1,20}\s*\Z"
)
# Template forms that plain prose doesn't have.
_FORM = re.compile(
    r"(?:\[\[|\{\{|<<|%%|@@|\{%|<%=|#\{|«)\s*([^\W\d_][\w' -]{1,50}?)\s*(?:\]\]|\}\}|>>|%%|@@|%\}|%>|\}|»)|\[(?:TODO|TBD|FIXME)[: ]\s*([^\]\n]{2,50})\]|<!-- ?([^\W\d_][\w' -]{2,40}?) ?-->|\bxxx ([\w' -]{2,40}?) xxx\b"
)
#: Words of short notices and failures; a text of at most ``SHORT`` bytes with one of them is one, unless it talks about it.
_NOTICE = re.compile(r"\b(?:javascript|scripts?|cookies?|browser|try again|sign in|log in|not found|access denied|went wrong|permission|permiso|no longer served|session (?:has ended|expired)|rate limit|help desk)\b", re.I)
SHORT = 200
#: Any form whose inside may be a name that the forms above use.
_MAYBE = re.compile(r"(?:[\[{<«(]|\$\{|\$\(|__|\.\.\.)\s*([^\W\d_][\w' -]{1,50}?)\s*\d?\s*(?:[\]}>»)]|__|\.\.\.)|\b(?:FIXME|TBD|TODO):? +([^\W\d_][\w' -]{1,40})", re.I)
#: Words with which real text talks about templates and pages.
_ABOUT = re.compile(r"\b(?:like|such as|fields?|contains?|counts?|marked|uses?|reads?|render\w*|required|example|instead of|percent|checks?|generics?)\b", re.I)
# Phrases that stand for content to come.
FILLERS = (
    "your text here", "text goes here", "write something here", "sample text", "dummy paragraph", "placeholder text", "insert text here", "replace me", "fill in later", "to be written",
    "to be completed", "to be determined", "to be defined", "to be added", "coming soon", "content to follow", "this section intentionally left for the author", "this page intentionally left blank",
    "asdf qwer asdf", "asdf", "blah", "lorem ipsum", "hier text ergänzen", "platzhaltertext", "text folgt", "texte à remplacer", "à compléter", "texto de relleno", "por completar",
)
# Openings and closings of placeholders.
FORMS = (
    ("[[", "]]"), ("{{", "}}"), ("${", "}"), ("<<", ">>"), ("__", "__"), ("@@", "@@"), ("«", "»"), ("%%", "%%"), ("xxx ", " xxx"), ("{% ", " %}"), ("<%= ", " %>"), ("$(", ")"), ("#{", "}"),
    ("<!-- ", " -->"), ("[TODO: ", "]"), ("...", "..."), ("{", "}"), ("[", "]"), ("<", ">"), ("FIXME ", ""), ("TBD: ", ""), ("TODO: ", ""),
)
#: Names of the sample that the fit puts into every form, at most, the most used first.
SEED_NAMES = 60
_FILLER = re.compile("(?:" + "|".join(map(re.escape, sorted(FILLERS, key=len, reverse=True))) + r")(?!\w)", re.I)
_REPEAT = re.compile(r"\W*(\w[\w/ ]{0,28}?)(?:[\s,/]+\1){2,}\W*(?:\d+\W*)?|\W*(?:\?{3,}\W*)+|\W*(?:x{3,}\W*){2,}", re.I)
_LEAD = re.compile(r"^(?:[-*+>•#\s(]+|\d{1,3}[.)]?\s+|\[?\d\d?:\d\d\]?\s*(?:UTC\s+)?)*(?:\w+: )?")
_UNUSUAL = re.compile(rb"[<>{}\[\]$%@#_\xc2*?]|\.\.|xxx|(?i:todo|tbd|fixme|lorem)")
_QUOTED = re.compile(rb"```[^\x00]*?(?:```|(?=\x00))|`[^`\n\x00]{1,200}`|\"[^\"\n\x00]{1,200}\"|\x00[^\x00]", re.S)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58], _LOWER[13], _LOWER[9] = 48, 10, 32
_CLASS = _LOWER.copy()
_CLASS[97:123] = _CLASS[128:] = 97
_DELIMITER = np.isin(np.arange(256), np.frombuffer(b"<>{}[]$%@#=|&*~^\\", np.uint8))


def _readings(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The three readings of bytes, each with the places of its bytes in ``data``."""
    n, low = len(data), _LOWER[data]
    place = np.arange(n, dtype=np.int32)
    yield low, place
    same = np.zeros(n + 1, bool)
    same[1:n] = low[1:] == low[:-1]
    delimiter = _DELIMITER[low] | ((same[:n] | same[1:]) & ((low == 95) | (low == 46) | (low == 45)))
    quote = np.zeros(n + 1, bool)
    quote[: n - 1] = (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))  # angle quotes in UTF-8
    delimiter |= quote[:n] | np.concatenate([[False], quote[: n - 1]])[:n]
    one = np.where(delimiter, np.uint8(1), low)
    keep = ~((one == 32) | (one == 95) | (one == 45))
    keep[1:] &= ~((one[1:] == 1) & (one[:-1] == 1))
    yield one[keep], place[keep]
    shape = _CLASS[data]
    keep = np.ones(n, bool)
    keep[1:] = ~((shape[1:] == shape[:-1]) & ((shape[1:] == 97) | (shape[1:] == 48) | (shape[1:] == 32)))
    yield shape[keep], place[keep]


def _hashes(b: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Hashed n-grams that start at each byte, one array per size; sizes rise, and the ends are padded."""
    n = len(b)
    wide = np.concatenate([b, np.zeros(12, np.uint8)]).astype(np.uint32)
    word = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    out = []
    for size in sizes:
        h = word[:n] * np.uint32(0x9E3779B1)
        at = 4
        while at + 4 <= size:
            h = (h ^ (word[at : at + n] * np.uint32(0x85EBCA6B) + np.uint32(at))) * np.uint32(0xC2B2AE35)
            at += 4
        while at < size:
            h = (h ^ (wide[at : at + n] + np.uint32(77 * at))) * np.uint32(0x27D4EB2F)
            at += 1
        out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


@dataclass(frozen=True)
class Segments:
    """The segments of several texts: bounds in their joined bytes, owner, features of each byte's n-grams, and dense features."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]
    quoted: np.ndarray
    code: np.ndarray
    dense: np.ndarray


def _segments(texts: list[str], with_grams: bool = True) -> Segments:
    raw = [t.encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    joined = b"\n\0".join([*raw, b""])
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    number = np.concatenate([[False], (data[:-2] >= 48) & (data[:-2] <= 57)]) if len(data) > 1 else np.zeros(0, bool)
    cut[1 : len(data)] |= ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & (data[1:] == 32) & ~number  # 3. begins an item
    cut[: len(data)] |= (data == 10) | (data == 13)
    begin = np.flatnonzero(cut[: len(data)])
    end = np.append(begin[1:], len(data))
    owner = np.searchsorted(starts, begin, "right") - 1
    ink = np.concatenate([[0], np.cumsum((data > 32) & (data != 0))])
    some = ink[end] > ink[begin]
    begin, end, owner = begin[some], end[some], owner[some]
    quoted, code = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if b"`" in joined or b'"' in joined:
        for m in _QUOTED.finditer(joined):
            if m.group()[:1] != b"\0":
                quoted[m.start() : m.end()] = True
                code[m.start() : m.end()] = m.group()[:1] == b"`"
    grams = []
    for k, (b, place) in enumerate(_readings(data) if with_grams else ()):
        which = [(j, size) for j, (reading, size) in enumerate(GRAMS) if reading == k]
        for (j, _), h in zip(which, _hashes(b, [size for _, size in which])):
            grams.append((place, h + np.int32(j << BITS)))
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    length, whole = np.log2(end - begin + 1).astype(np.int32), np.log2(sizes[owner]).astype(np.int32)
    dense = np.stack([length + 64 * first, 128 + whole], 1) + (len(GRAMS) << BITS) if len(owner) else np.zeros((0, 2), np.int64)
    return Segments(joined, begin, end, owner, grams, quoted, code, dense)


@dataclass(frozen=True)
class ResidueModel:
    """Weights of template residue (placeholders and filler) and of error pages, with their biases, and what was measured on unseen hosts."""

    template: np.ndarray
    error: np.ndarray
    bias: tuple[float, float]
    report: dict

    def segment_scores(self, s: Segments) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each segment for template residue and for error pages; code counts for neither, what stands in quotes not for the first."""
        out = []
        for weights, bias, plain in ((self.template, self.bias[0], True), (self.error, self.bias[1], False)):
            total = np.zeros(len(s.data) + 1)
            for place, h in s.grams:
                value = weights[h]
                value = np.where((s.quoted if plain else s.code)[place], np.float32(0), value)
                total[1:] += np.bincount(place, value, len(s.data)) if len(place) < len(s.data) else value
            np.cumsum(total, out=total)
            out.append(total[s.end] - total[s.begin] + weights[s.dense].sum(1) + bias)
        return out[0], out[1]

    def kinds(self, texts: list[str]) -> list[str | None]:
        """``placeholder``, ``filler`` or ``error`` per text, None for real texts and those without a segment."""
        s = _segments(texts)
        template, error = self.segment_scores(s)
        size = (s.end - s.begin).astype(np.float64)
        whole = np.bincount(s.owner, size, len(texts))
        share = np.bincount(s.owner, size / (1 + np.exp(-np.clip(error - ERROR_AT, -30, 30))), len(texts)) / np.maximum(whole, 1)
        out: list[str | None] = [None] * len(texts)
        found = np.flatnonzero(template >= TEMPLATE_AT)
        for k in found[np.argsort(-template[found], kind="stable")]:
            if out[s.owner[k]] is None:
                out[s.owner[k]] = "placeholder" if re.search(rb"[\[{<$@%_]|\xc2[\xab\xbb]|TODO|FIXME|TBD|xxx|\.\.\.\w", s.data[s.begin[k] : s.end[k]]) else "filler"
        for t in np.flatnonzero((share >= ERROR_SHARE) & (whole > 0)):
            out[t] = "error"
        return out


def _name(text: str) -> str:
    return re.sub(r"[\W\d_]+", "", text.lower())


def _plain(segment: bytes, quoted: np.ndarray) -> str:
    """A segment's text with what is quoted blanked out."""
    out = np.frombuffer(segment, np.uint8).copy()
    out[quoted] = 2
    return out.tobytes().decode("utf-8", "replace")


def _seeds(names: list[str]) -> list[str]:
    """Every form around every name, and every filler phrase, in several surroundings: no weak label is too rare to be learned."""
    cased = (str.lower, str.upper, str.title, lambda n: n.lower().replace(" ", "_"), lambda n: n.title().replace(" ", ""))
    around = ("{}", "* Owner: {}", "Ticket: {}. The cost stays flat.", "1. {}", "Approved by {} on the new broker.")
    out = [around[(i + j) % len(around)].format(o + cased[(2 * i + j) % len(cased)](n) + c) for i, n in enumerate(names) for j, (o, c) in enumerate(FORMS)]
    for f in (*FILLERS, "???", "n/a n/a n/a", "test test 123", "xxxxx xxxxx xxx"):
        out += [f, f.upper(), f"({f})", f"{f.capitalize()}.", f"1. {f}", f"12:05 UTC {f}", " ".join([f] * 3), f"Status: {f}"]
    return out


def weak_labels(texts: list[str], s: Segments) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Weak labels of segments, template residue and error pages, and the names that the forms use, the most used first.

    Names inside unambiguous template forms are collected; a name of at least two texts
    counts inside any form.  Where a segment talks about such things it is none.
    """
    pieces = [s.data[a:b] for a, b in zip(s.begin, s.end)]
    plain = [_plain(p, s.quoted[a:b]) if len(p) < 64 or _UNUSUAL.search(p) else "" for p, a, b in zip(pieces, s.begin, s.end)]
    used: dict[str, set[int]] = defaultdict(set)
    spelled: dict[str, Counter] = defaultdict(Counter)
    for t, owner in zip(plain, s.owner):
        for m in _FORM.finditer(t) if t and not _ABOUT.search(t) else ():
            inside = next(g for g in m.groups() if g)
            used[_name(inside)].add(int(owner))
            spelled[_name(inside)][re.sub(r"[\s_-]+", " ", inside.lower()).strip()] += 1
    names = {n for n, owners in used.items() if len(owners) >= 2 and len(n) > 2}
    seeds = [max(spelled[n], key=lambda k: (k.count(" "), spelled[n][k], k)) for n in sorted(names, key=lambda n: (-len(used[n]), n))]

    def template(t: str) -> bool:
        if not t or _ABOUT.search(t):
            return False
        core = _LEAD.sub("", t).strip()
        if _REPEAT.fullmatch(core) or (m := _FILLER.match(core)) and (len(core) < m.end() + 4 or core.lower().startswith("lorem")):
            return True
        return _FORM.search(t) is not None or any(_name(next(g for g in m.groups() if g)) in names for m in _MAYBE.finditer(t))

    error = np.array([_STATUS.search(t) is not None or len(t) <= SHORT and _NOTICE.search(t) is not None and not _ABOUT.search(t) and "`" not in t for t in texts], bool)
    return np.array([template(t) for t in plain], bool), error[s.owner] if len(s.owner) else np.zeros(0, bool), seeds


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``SLICE_BYTES`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < SLICE_BYTES:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _rows(texts: list[str], keep: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features of the kept segments of all texts: (place in ``keep``, feature) in order of the place."""
    owners, features, base = [], [], 0
    for part in _slices(texts):
        s = _segments(part)
        lo, hi = np.searchsorted(keep, [base, base + len(s.begin)])
        mine = keep[lo:hi] - base
        number = np.full(len(s.begin), -1, np.int32)
        number[mine] = np.arange(lo, hi)
        owner, feature = [np.repeat(np.arange(lo, hi, dtype=np.int32), s.dense.shape[1])], [s.dense[mine].ravel().astype(np.int32)]
        for place, h in s.grams:
            seg = np.maximum(np.searchsorted(s.begin, place, "right") - 1, 0)
            ok = (number[seg] >= 0) & (place >= s.begin[seg]) & (place < s.end[seg]) & ~(s.quoted if plain else s.code)[place]
            owner.append(number[seg[ok]])
            feature.append(h[ok])
        at, f = np.concatenate(owner), np.concatenate(feature)
        order = np.argsort(at, kind="stable")
        owners.append(at[order])
        features.append(f[order])
        base += len(s.begin)
    return (np.concatenate(owners), np.concatenate(features)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _expand(owner: np.ndarray, feature: np.ndarray, times: np.ndarray, y: np.ndarray, blocked: np.ndarray, text: np.ndarray | None = None, size: np.ndarray | None = None, whole: np.ndarray | None = None) -> np.ndarray:
    """Labels with the unlabelled segments added whose n-grams are mostly those of labelled ones.

    With ``text``, the number of each segment's text, a label that most of a text has goes
    to all its segments: that is how the frames of error pages are learned.

    The mean log-ratio of n-gram frequencies doesn't mind that such segments were counted
    among the rest, unlike a classifier that has learned them as such.
    """
    for _ in range(PASSES):
        if not y.any() or y.all():
            return y
        score = np.bincount(owner, np.clip(_ratio(feature, times[owner], y[owner]), -4, 6)[feature], len(y)) / np.maximum(np.bincount(owner, minlength=len(y)), 1)
        more = y | ((score >= EXPAND_AT) & ~blocked)
        if text is not None:
            more |= (np.bincount(text, size * more, len(whole)) >= ERROR_SHARE * np.maximum(whole, 1))[text]
        if (more == y).all():
            break
        y = more
    return y


def _ratio(feature: np.ndarray, times: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Log-ratio of each n-gram's frequency in known segments to that in the rest."""
    seen = np.bincount(feature, times, TABLE)
    hits = np.bincount(feature[known], times[known], TABLE)
    part = (hits.sum() + 1) / (seen.sum() + 2)
    return np.log((hits + SMOOTH * part) / part) - np.log((seen - hits + SMOOTH * (1 - part)) / (1 - part))


def _regress(owner: np.ndarray, feature: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by AdaGrad over n-grams scaled by their log-ratio; deterministic.

    The scaling makes what is rare but telling count at once, so that a form seen a few
    times is known in other surroundings.
    """
    bias, bias_squares = -2.0, 1e-6
    if not y.any():
        return np.zeros(TABLE, np.float32), bias
    scale = np.clip(_ratio(feature, times[owner], y[owner]), -3, 6).astype(np.float32)
    scale[np.bincount(feature, minlength=TABLE) == 0] = 0
    v, squares = np.full(TABLE, START, np.float32), np.full(TABLE, 1e-6, np.float32)
    first = np.searchsorted(owner, np.arange(len(y)))
    sizes = np.diff(np.append(first, len(owner)))
    weight = np.where(y, POSITIVE_WEIGHT, 1.0) * times
    for _ in range(EPOCHS):
        w = v * scale
        z = np.add.reduceat(w[feature], first) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = (np.bincount(feature, np.repeat(r, sizes), TABLE) / times.sum()).astype(np.float32) * scale + np.float32(L2) * v
        squares += g * g
        v -= np.float32(RATE) * g / np.sqrt(squares)
        mean = float(r.sum() / times.sum())
        bias_squares += mean * mean
        bias -= 0.5 * mean / bias_squares**0.5
    return v * scale, bias


def fit(rows: list[tuple[str, str]]) -> ResidueModel:
    """Fit on (host, text) rows; a fifth of the hosts is held back and takes no part, in threshold or weights.

    Deterministic: draws depend on the rows' order only.  Without rows nothing is residue.
    """
    held = {h for h in {h for h, _ in rows} if sum(h.encode()) % 5 == 0}
    texts, unseen = [t for h, t in rows if h not in held], [t for h, t in rows if h in held]
    s = _segments(texts, False)
    template, error, names = weak_labels(texts, s)
    if texts:
        pages = [f.format(code=p.value, phrase=p.phrase) for p in HTTPStatus if p.value >= 400 for f in ("{code} {phrase}", "{phrase}", "<html><head><title>{code} {phrase}</title></head><body><h1>{phrase}</h1></body></html>")]
        made = _segments(seeded := [*_seeds(names[:SEED_NAMES]), *pages], False)
        texts = [*texts, *seeded]
        s = _segments(texts, False)
        # a seed's segments are residue but for the sentence behind it
        page = made.owner >= len(seeded) - len(pages)
        extra = ~page & np.array([not made.data[a:b].startswith(b" The cost") for a, b in zip(made.begin, made.end)], bool)
        template, error = np.concatenate([template, extra]), np.concatenate([error, page])
    rng = np.random.default_rng(7)
    pieces = [s.data[a:b] for a, b in zip(s.begin, s.end)]
    known = template | error
    once: dict[bytes, int] = {}
    plain: dict[bytes, int] = {}
    times = np.ones(len(pieces))
    for k in np.flatnonzero(~known):  # what isn't labelled is kept once, whatever its numbers, with how often it occurs
        first = (once if len(pieces[k]) < 48 or _UNUSUAL.search(pieces[k]) else plain).setdefault(re.sub(rb"\d+", b"0", pieces[k]), int(k))
        times[first] += first != k
    rest = np.array(list(plain.values()), np.int64)
    keep = np.sort(np.concatenate([np.flatnonzero(known), np.array(list(once.values()), np.int64), rng.choice(rest, min(len(rest), SAMPLE_SEGMENTS), replace=False)]))
    size = (s.end - s.begin).astype(np.float64)
    about = np.array([_ABOUT.search(pieces[k].decode("utf-8", "replace")) is not None for k in keep], bool)
    owner, feature = _rows(texts, keep, True)
    w_template, b_template = _regress(owner, feature, _expand(owner, feature, times[keep], template[keep], about | error[keep]), times[keep])
    owner, feature = _rows(texts, keep, False)
    w_error, b_error = _regress(owner, feature, _expand(owner, feature, times[keep], error[keep], about, s.owner[keep], size[keep], np.bincount(s.owner, size)), times[keep])
    model = ResidueModel(w_template, w_error, (b_template, b_error), {})
    report = {"documents": len(rows), "held_hosts": len(held), "held_documents": len(unseen)}
    if unseen:
        known_segments, known_error, _ = weak_labels(unseen, u := _segments(unseen, False))
        weak = np.zeros(len(unseen), bool)
        weak[u.owner[known_segments | known_error]] = True
        found = np.array([k is not None for part in _slices(unseen) for k in model.kinds(part)])
        report |= {"weakly_labelled": int(weak.sum()), "found": int(found.sum()), "both": int((weak & found).sum())}
    return ResidueModel(w_template, w_error, (b_template, b_error), report)


def train(documents: DataFrame, max_docs: int = SAMPLE_DOCS, max_short: int = SAMPLE_SHORT) -> ResidueModel:
    """Fit on at most ``max_docs`` texts and ``max_short`` more short ones, drawn by a hash of the id, with the repository as host."""
    usable = documents.where(F.length(F.trim("text")) > 0).select("doc_id", F.coalesce("repo", F.lit("")).alias("repo"), "text")
    short = F.length("text") <= SHORT
    n = usable.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(short, 1)).alias("short")).first()
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    upto = lambda most, of: int(min(1.0, most / max(1, of)) * 1_000_000) + 1
    first = place < upto(max_docs, n["all"])
    rows = usable.where(first).limit(max_docs).unionByName(usable.where(~first & short & (place >= 1_000_000 - upto(max_short, n["short"]))).limit(max_short)).collect()
    return fit([(r.repo, r.text) for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.text))])


def judge(documents: DataFrame, model: ResidueModel | None = None) -> DataFrame:
    """(doc_id, kind) of every document that is residue; kinds are placeholder, filler and error.

    Null, empty and blank texts are no residue.  Repeated rows are judged each.  One
    pass without a shuffle of large inputs; the model (fixed size, about 6 MB) is broadcast.
    """
    model = model or train(documents)
    held = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [k for part in _slices(batch.column(1).to_pylist()) for k in m.kinds(part)]
            rows = [i for i, k in enumerate(found) if k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([found[i] for i in rows], pa.string())], ["doc_id", "kind"])

    return spread(documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, kind string")


def without_residue(documents: DataFrame, model: ResidueModel | None = None) -> DataFrame:
    """The documents that are no residue, whatever their other columns; rows with a null id are kept."""
    return documents.join(judge(documents, model).select("doc_id").distinct(), "doc_id", "left_anti")
