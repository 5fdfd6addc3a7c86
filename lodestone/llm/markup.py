"""Markup residue in texts: leaves, a recurrent block labeller, and clean text.

A text in HTML, Markdown, wiki markup, LaTeX or a mixture is read into leaves: its
smallest blocks in order, each with a tag path.  A bidirectional LSTM in numpy reads a
document's leaves (hashed tag path, hashed words, hashed shapes of words with unusual
characters) and labels every leaf with the whole document in view.  It is trained here
on weak labels, which come from the paths and from `residue_marks`; no rule is part of
its input, and whether a summary holds residue is what the network says.  Labels decide
how a leaf is written: headings, lists, tables, code and formulas stay recognisable;
the rest becomes prose without inline markup.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, spread

LABELS = ("paragraph", "heading", "list", "table", "code", "formula", "meta", "residue")
#: Records the labeller is trained on, at most; drawn by a hash of the key.
SAMPLE_RECORDS = 1500
#: Summaries that are drawn and weakly labelled, at most, and how many clean ones the fit takes for each with residue.
SAMPLE_SUMMARIES, CLEAN_SHARE = 12_000, 3
HIDDEN, WORD_DIMS, PATH_DIMS = 16, 12, 12
EPOCHS, RATE, BATCH = 8, 0.01, 32
#: A missed residue leaf costs as much as so many false ones.
RESIDUE_WEIGHT = 2.0
#: Leaves, padding included, that are read at once; a longer document is read alone.
SLOTS = 16_384

# Tags of HTML and of wiki dialects.
TAGS = (
    "a abbr b big blockquote body br button caption center cite code col dd del div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd li "
    "link main mark meta nav nowiki ol option p pre q ref references s samp script section select small source span strike strong style sub sup svg syntaxhighlight table tbody td tfoot th thead title tr tt u ul var video"
).split()
# LaTeX commands.
COMMANDS = (
    "alpha approx begin beta bibitem caption cdot chapter cite citep citet documentclass emph end enquote eqref footnote frac gamma ge geq hline href hspace includegraphics infty item "
    "label lambda latex ldots le left leq maketitle mathbf mathrm mbox mu neq newline newpage noindent pageref pagebreak paragraph par ref right section sigma sqrt subsection subsubsection sum "
    "textbf textit textrm textsc texttt times title underline url usepackage verb vspace"
).split()
ENTITIES = "amp lt gt quot nbsp apos ndash mdash hellip copy reg trade rsquo lsquo rdquo ldquo bull middot euro times laquo raquo shy thinsp ensp emsp auml ouml uuml szlig eacute egrave agrave ccedil".split()

_TAG = "|".join(sorted(TAGS, key=len, reverse=True))
_COMMAND = "|".join(sorted(COMMANDS, key=len, reverse=True))
RULES = {
    "tag": re.compile(rf"</?(?:{_TAG})(?=[\s>/])|<!(?:--|doctype)|-->|<(?:{_TAG})$|(?<=\s)(?:{_TAG})\s*/>", re.I),
    "entity": re.compile(rf"&(?:[A-Za-z][A-Za-z0-9]{{1,30}};|#\d{{1,7}};?|#[xX][0-9A-Fa-f]{{1,6}};?|(?:{'|'.join(ENTITIES)})(?![A-Za-z0-9=]))|(?<=[\s\w])#\d{{2,5}};"),
    "emphasis": re.compile(r"(?<![\w*/\\])\*{1,3}(?=[^\s*.])(?:[^*\n]{0,300}?[^\s*])?\*{1,3}(?![\w*/])|(?:(?<=\s)|^)\*{2,3}(?=\w)|(?<=\w)\*{2,3}(?=[\s.,;:)]|$)|~~|(?<![\w])__(?!(?:init|main|name|file|all|doc|dict|class|call|str|repr|eq|new|del|iter|next|len|version|author)__)(?=\S)[^\n]{0,300}?(?<=\S)__(?!\w)|(?<![\w/\\.])_(?=[^\W_])[^_\n]{1,300}(?<=[^\s_])_(?![\w/])"),
    "code": re.compile(r"`"),
    "link": re.compile(r"\[[^\[\]\n]*\]\([^()\n]*\)?|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^\w+\]|!\[|\[[^\[\]\n]+\]: ?\S"),
    "heading": re.compile(r"(?m)^\s{0,3}#{1,6}\s+\S|(?<=\s)#{2,6}\s|^\s*={2,6}[^=\n]+={2,6}\s*$|(?:^|(?<!\b\w)\s)={2,6}\s?\w[^=\n]*\S\s?={2,6}(?=\s|$)|^\s*h[1-6]\.\s"),
    "table": re.compile(r"\|\s*:?-{3,}|-{3,}:?\s*\||\{\||\|\}|(?m:^\s*\|.*\|\s*$)|\|\|"),
    "quote": re.compile(r"(?m)^\s*>\s|(?<=[\w.,;:] )> (?=\*{1,3}\w)"),
    "wiki": re.compile(r"\[\[|\]\]|\{\{|\}\}|'{3,}|(?<!')''(?!')(?=\S)|\{(?:code|color|panel|noformat|quote|info|note|tip|warning|toc|anchor|expand|status)\b[^{}\n]*\}|__(?:TOC|NOTOC)__"),
    "latex": re.compile(rf"(?<![\w:\\])~?\\(?:{_COMMAND})(?![A-Za-z])|\\[A-Za-z]+\{{|\w~\\[A-Za-z]+|\\[()\[\]](?=[\s\w\\])|(?<=\w)\\\)|\$(?!\d)[^$\n]*[\\^_{{][^$\n]*\$|\$\$"),
}


#: A text without any of a rule's strings can't match it.
TRIGGERS = {
    "tag": ("<", "-->", "/>"), "entity": ("&", ";"), "emphasis": ("*", "_", "~~"), "code": ("`",), "link": ("[",), "heading": ("#", "==", *(f"h{k}." for k in range(1, 7))),
    "table": ("|",), "quote": (">",), "wiki": ("[[", "]]", "{", "}}", "''", "__"), "latex": ("\\", "$"),
}


def _rules_for(text: str) -> Iterator[tuple[str, re.Pattern]]:
    return ((kind, rule) for kind, rule in RULES.items() if any(t in text for t in TRIGGERS[kind]))


def residue_marks(text: str | None) -> list[str]:
    """The kinds of markup that a text still holds, whole or broken; none for null and clean texts.

    Comparison signs, operators, paths, variables, type names and prices are no markup.
    """
    return [kind for kind, rule in _rules_for(text) if rule.search(text)] if text else []


_BLOCK = set("address article aside blockquote body caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul script style".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>", re.S)
_VOID = {"br", "hr", "img", "input", "meta", "link", "col"}
_LINES = (
    ("heading", "md/h", re.compile(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")),
    ("heading", "wiki/h", re.compile(r"\s*(={2,6})\s*(.+?)\s*={2,6}\s*$")),
    ("heading", "wiki/title", re.compile(r"(=)\s+([^=].*?)\s+=\s*$")),
    ("heading", "jira/h", re.compile(r"\s*h([1-6])\.\s+(.*)$")),
    ("heading", "tex/h", re.compile(r"\s*\\(title|chapter|section|subsection|subsubsection|paragraph)\*?\{(.*?)\}\s*(?:\\label\{[^}]*\})?\s*$")),
    ("meta", "tex/frame", re.compile(r"\s*\\(documentclass|usepackage|maketitle|newpage|pagebreak|label|tableofcontents|author|date)\b(.*)$")),
    ("meta", "tex/env", re.compile(r"\s*\\(begin|end)\{(?:document|itemize|enumerate|description|abstract|center|quote|table|figure|tabular)\}(.*)$")),
    ("meta", "wiki/frame", re.compile(r"\s*(__TOC__|__NOTOC__|\[\[Category:|\{\{|\}\}|\{\||\|\}|\{toc|\{anchor|\[//\]|---+\s*$|===+\s*$|\*\*\*+\s*$)(.*)$")),
    ("table", "md/table", re.compile(r"\s*(\|\|?|!)(.*)$")),
    ("table", "tex/table", re.compile(r"([^&]*(?<!\\)&)(.*)\\\\\s*(?:\\hline)?\s*$")),
    ("list", "md/li", re.compile(r"\s*([-+•]|\*+|\d{1,3}[.)]|#+)\s+(.*)$")),
    ("list", "wiki/term", re.compile(r"\s*([;:]+)\s+(.*)$")),
    ("list", "tex/field", re.compile(r"\s*(%+)\s*([A-Z][\w ]{1,30}:\s.*)$")),
    ("meta", "tex/comment", re.compile(r"\s*(%+)(.*)$")),
    ("list", "tex/li", re.compile(r"\s*(\\item)\s*(.*)$")),
    ("formula", "tex/math", re.compile(r"\s*(\$\$|\\\[|<math>)(.*?)(?:\$\$|\\\]|</math>)\s*$")),
    ("paragraph", "md/quote", re.compile(r"\s*(>+)\s?(.*)$")),
)
_CODE_ENDS = (
    (re.compile(r"\s*(```+|~~~+)\s*\w*\s*$"), lambda m: re.compile(rf"\s*{re.escape(m.group(1))}\s*$")),
    (re.compile(r"\s*\\begin\{(verbatim|lstlisting|minted)\}.*$"), lambda m: re.compile(rf"\s*\\end\{{{m.group(1)}\}}")),
    (re.compile(r"\s*\{(code|noformat)[^}]*\}\s*$"), lambda m: re.compile(rf"\s*\{{{m.group(1)}\}}\s*$")),
    (re.compile(r"\s*<(syntaxhighlight|source)\b[^>]*>\s*$", re.I), lambda m: re.compile(rf"\s*</{m.group(1)}>\s*$", re.I)),
)
_MATH = re.compile(r"\s*(?:\\begin\{(equation|align|displaymath|math)\*?\}|(\\\[|\$\$))\s*$")


@dataclass
class Leaf:
    path: str
    text: str
    guess: str
    level: int = 0
    marker: str = ""
    label: str = field(default="")


def leaves(text: str) -> list[Leaf]:
    """The leaves of a text in order.  Every character outside tags, markers and frames is in one of them."""
    if not text:
        return []
    out: list[Leaf] = []
    if re.search(r"<(?:p|div|ul|ol|li|h[1-6]|table|pre|body)\b[^<>]*>", text, re.I):
        stack: list[str] = []
        held: list[str] = []

        def flush() -> None:
            body = "".join(held)
            held.clear()
            if not body.strip():
                return
            block = [t for t in stack if t in _BLOCK]
            last = block[-1] if block else ""
            path = "/".join(["html", *block[-3:]])
            if "pre" in block:
                out.append(Leaf(path, body, "code"))
            elif last in ("script", "style"):
                out.append(Leaf(path, body, "meta"))
            elif last[:1] == "h" and last[1:].isdigit():
                out.append(Leaf(path, body.strip(), "heading", int(last[1])))
            elif last == "title":
                out.append(Leaf(path, body.strip(), "heading", 1))
            elif last in ("li", "dt", "dd"):
                out.append(Leaf(path, body.strip(), "list", sum(t in ("ul", "ol") for t in block)))
            elif last in ("td", "th", "tr"):
                out.append(Leaf(path, body.strip(), "table", marker=last))
            else:
                out.extend(_line_leaves(body, path))

        at = 0
        for m in _TOKEN.finditer(text):
            held.append(text[at : m.start()])
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                flush()
                out.append(Leaf("html/comment", m.group(), "meta"))
                continue
            inside_code = "pre" in stack and name != "pre"
            if name not in _BLOCK or inside_code:
                held.append("" if inside_code and name in ("code", "span") else m.group())
                continue
            flush()
            if m.group(1):
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif name not in _VOID:
                if name in ("p", "li", "td", "th", "tr") and stack and stack[-1] == name:
                    stack.pop()
                stack.append(name)
                if name == "tr":
                    out.append(Leaf("html/tr", "", "table", marker="tr"))
        held.append(text[at:])
        flush()
        return out
    return _line_leaves(text, "")


def _line_leaves(text: str, base: str) -> list[Leaf]:
    out: list[Leaf] = []
    lines = re.split(r"\r\n|\r|\n", text)
    joined: list[str] = []

    def flush() -> None:
        if joined:
            out.append(Leaf(base or "txt/p", " ".join(joined), "paragraph"))
            joined.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if not line.strip():
            flush()
            continue
        for start, end in _CODE_ENDS:
            if m := start.match(line):
                flush()
                stop, body = end(m), []
                while i < len(lines) and not stop.match(lines[i]):
                    body.append(lines[i])
                    i += 1
                i += 1
                out.append(Leaf("code", "\n".join(body), "code"))
                break
        else:
            if m := _MATH.match(line):
                flush()
                body = []
                while i < len(lines) and not re.match(r"\s*(?:\\end\{|\\\]|\$\$)", lines[i]):
                    body.append(lines[i])
                    i += 1
                i += 1
                out.append(Leaf("tex/math", "\n".join(body), "formula"))
                continue
            if re.match(r"(?: {4}|\t)\S", line) and not joined and not (out and out[-1].guess == "list"):
                out.append(Leaf("indent", line, "code" if re.search(r"[=;{}()<>]|^\s+(?:\$|#|import|def|for|if)\b", line) else "paragraph"))
                continue
            for guess, path, rule in _LINES:
                if m := rule.match(line):
                    flush()
                    mark, rest = m.group(1), m.group(2)
                    level = len(mark) if path in ("md/h", "wiki/h", "wiki/title") else int(mark) if path == "jira/h" else {"title": 1, "chapter": 1, "section": 2, "subsection": 3}.get(mark, 4) if path == "tex/h" else len(line) - len(line.lstrip()) if guess == "list" else 0
                    body = line.strip() if guess in ("meta", "table") else rest
                    out.append(Leaf(f"{base}/{path}" if base else path, body, guess, level, mark))
                    break
            else:
                joined.append(line.strip())
                if not base and len(joined) == 1 and re.match(r"[A-Z][\w ]{1,30}:\s", line):
                    flush()
    flush()
    return out


_INLINE = (
    (re.compile(r"<!--.*?(?:-->|\Z)", re.S), ""),
    (re.compile(r"(?i)<br\s*/?>"), "\n"),
    (re.compile(r"<(?:ref)\b[^<>]*>|</ref>", re.I), ""),
    (re.compile(rf"</?(?:{_TAG})(?:\s[^<>]*)?/?>", re.I), ""),
    (re.compile(rf"<(?:{_TAG})(?=\s|$)", re.I), ""),
    (re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    (re.compile(r"\[\^\w+\]:?"), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?|mailto)[^\s\]|]*[\s|]([^\]\n]*)\]"), r"\1"),
    (re.compile(r"\[([^\[\]|\n]+)\|[^\[\]\n]+\]"), r"\1"),
    (re.compile(r"\{\{(?:[^{}|\n]*\|)?([^{}\n]*)\}\}"), r"\1"),
    (re.compile(r"\{(?:code|color|panel|noformat|quote|info|note|tip|warning|toc|anchor|expand|status)\b[^{}\n]*\}"), ""),
    (re.compile(r"'{2,5}"), ""),
    (re.compile(r"`{1,3}([^`\n]*)`{1,3}"), r"\1"),
    (re.compile(r"(?<![\w*/\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*]|)\1(?![\w*])"), r"\2"),
    (re.compile(r"(?<!\w)(__)(?=\S)([^\n]*?\S)\1(?!\w)"), r"\2"),
    (re.compile(r"(?<![\w/\\.])_(?=[^\W_])([^_\n]*[^\s_])_(?![\w/])"), r"\1"),
    (re.compile(r"~~"), ""),
    (re.compile(r"\\(?:textbf|textit|texttt|textsc|textrm|emph|underline|enquote|mbox|section|subsection|footnote|url|caption|title)\*?\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"),
    (re.compile(r"~?\\(?:ref|cite|citep|citet|label|eqref|pageref)\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}|\\item\b"), ""),
    (re.compile(r"\\([&%$#_{}])"), r"\1"),
    (re.compile(r"(?m)^\s*>+\s?"), ""),
    (re.compile(r"(?<=\s)#{2,6}\s"), ""),
    (re.compile(r"\|?\s*:?-{3,}:?\s*\|"), ""),
)


def inline_clean(text: str) -> str:
    """Prose without inline markup and character entities; formulas between dollars stay."""
    for _ in range(2):
        before = text
        for rule, to in _INLINE:
            text = rule.sub(to, text)
        text = html.unescape(text)
        if text == before:
            break
    return re.sub(r"[ \t\u00a0]+", " ", text).strip()


# What `inline_clean` leaves: formulas, headings and quotes inside a line, and markers without their other half.
_REST = (
    (re.compile(r"\$(?!\d)([^$\n]*[\\^_{][^$\n]*)\$"), r"\1"),
    (re.compile(r"\\frac\{([^{}\n]*)\}\s*\{([^{}\n]*)\}"), r"\1/\2"),
    (re.compile(r"\\leq?(?![A-Za-z])"), "≤"),
    (re.compile(r"\\geq?(?![A-Za-z])"), "≥"),
    (re.compile(r"\\times(?![A-Za-z])"), "×"),
    (re.compile(r"\\[A-Za-z]+\{([^{}\n]*)\}"), r"\1"),
    (re.compile(rf"~?\\(?:{_COMMAND})(?![A-Za-z])(?:\{{[A-Za-z]*\}}?)?"), " "),
    (re.compile(r"\\[()\[\]]"), ""),
    (re.compile(r"={2,6}\s?([^\s=][^=\n]*?)\s?={2,6}"), r"\1"),
    (re.compile(r"> (?=\*{1,3}\w)"), ""),
    (re.compile(r"(?<!\w)\*{2,3}(?=\w)|(?<=\w)\*{2,3}(?!\w)"), ""),
)
_WORDLESS = re.compile(r"[^\w\s.,;:'-]+|__+|'{2,}|-{3,}|(?<!\w)_|_(?!\w)")


def clean_summary(text: str) -> str:
    """A summary without markup, whole or broken; its lines stay.  A text without marks is returned as it is."""
    if not residue_marks(text):
        return text
    text = inline_clean(text)
    for rule, to in _REST:
        text = rule.sub(to, text)
    # a marker that none of the rules knows how to read loses its signs; tags and entities go as a whole
    for _ in range(8):
        found = residue_marks(text)
        if not found:
            break
        for kind in found:
            text = RULES[kind].sub("" if kind in ("tag", "entity") else lambda m: _WORDLESS.sub("", m.group()), text)
    return "\n".join(re.sub(r"[ \t\u00a0]+", " ", line).strip() for line in text.split("\n")).strip()


def render(parts: list[Leaf]) -> str:
    """Clean text of labelled leaves: headings with ``#``, lists with ``-``, fenced code, ``$$`` formulas, piped tables."""
    out: list[str] = []
    row: list[str] = []

    def end_row() -> None:
        if row:
            out.append(" | ".join(row))
            row.clear()

    previous = ""
    for p in parts:
        label = p.label or p.guess
        if label != "table" or p.marker == "tr":
            end_row()
        if label == "meta":
            continue
        if label == "code":
            body = html.unescape(p.text).strip("\n")
            if previous == "code" and p.path == "indent" and out:
                out[-1] = out[-1].removesuffix("\n```") + f"\n{body}\n```"
            else:
                out.append(f"```\n{body}\n```")
        elif label == "formula":
            out.append(f"$$ {p.text.strip().strip('$').strip()} $$")
        elif label == "heading":
            out.append("#" * max(1, min(6, p.level or 2)) + " " + inline_clean(p.text))
        elif label == "list":
            out.append("- " + inline_clean(p.text))
        elif label == "table":
            if p.marker in ("td", "th"):
                row.append(inline_clean(p.text))
            elif p.text and not re.fullmatch(r"[\s|:+-]*", p.text):
                cells = [inline_clean(c) for c in re.split(r"\|\|?|!!|(?<!\\)&", re.sub(r"\\\\\s*(?:\\hline)?\s*$", "", p.text.strip().strip("|!")))]
                out.append(" | ".join(cells))
        elif body := inline_clean(p.text):
            out.append(body)
        previous = label
    end_row()
    text = ""
    for k, block in enumerate(out):
        close = k and (block.startswith("- ") and out[k - 1].startswith("- ") or " | " in block and " | " in out[k - 1] and "\n" not in block)
        text += ("\n" if close else "\n\n" if k else "") + block
    return text


_SHAPES = ("<", ">", "&", ";", "\\", "{", "}", "[", "]", "*", "_", "~", "`", "|", "#", "$", "'", "=", "/", "^", "!", "(", ":", "-")
#: A word with a character that plain prose doesn't have, or with several apostrophes, dots or dashes at once.
_UNUSUAL = re.compile(r"[^\w\s.,;:()'\"?!-]|_|''|\.\.|--|^[^\w\s]+$|\w[:;]\w")
_RUNS = ((re.compile(r"[^\W\d_]{2,}"), "w"), (re.compile(r"(?<![^\W\d_])[^\W\d_w](?![^\W\d_])"), "x"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1{2,}"), r"\1\1\1"))
_SHAPE_DIMS = 512
_rng = np.random.default_rng(20_240_601)
_WORDS = _rng.normal(0, 1, (4096, WORD_DIMS)).astype(np.float32)
_PATHS = _rng.normal(0, 1, (512, PATH_DIMS)).astype(np.float32)
INPUT = PATH_DIMS + WORD_DIMS + len(_SHAPES) + _SHAPE_DIMS + 4


@lru_cache(maxsize=1 << 16)
def _shape(word: str) -> str:
    """A word with its letters, single letters and digits as ``w``, ``x`` and ``0``."""
    for rule, to in _RUNS:
        word = rule.sub(to, word)
    return word


@lru_cache(maxsize=1 << 16)
def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


@lru_cache(maxsize=1 << 16)
def _unusual(word: str) -> bool:
    return _UNUSUAL.search(word) is not None


def features(leaf: Leaf) -> np.ndarray:
    """A leaf as a vector: tag path, mean of its hashed words, counts of signs, hashed shapes of unusual words.

    An unusual word gives its shape, its shape with those of its neighbours if it has no
    letter or digit, and the pairs and triples of signs inside it.
    """
    out = np.zeros(INPUT, np.float32)
    out[:PATH_DIMS] = _PATHS[_slot(leaf.path, len(_PATHS))]
    text = leaf.text
    words = text.split()
    if words:
        out[PATH_DIMS : PATH_DIMS + WORD_DIMS] = _WORDS[[_slot(w.lower(), len(_WORDS)) for w in words]].mean(0)
    at = PATH_DIMS + WORD_DIMS
    for k, c in enumerate(_SHAPES):
        if c in text:
            out[at + k] = min(3.0, np.log1p(text.count(c)))
    at += len(_SHAPES)
    for i, w in enumerate(words):
        if _unusual(w):
            shape = _shape(w)
            out[at + _slot(shape, _SHAPE_DIMS)] = 1.0
            if not any(c in "wx0" for c in shape):
                near = (_shape(words[i - 1]) if i else "^", _shape(words[i + 1]) if i + 1 < len(words) else "$")
                out[at + _slot(f"{near[0]} {shape} {near[1]}", _SHAPE_DIMS)] = 1.0
                out[at + _slot(f"{near[0]} {shape}", _SHAPE_DIMS)] = 1.0
            for n in (2, 3):
                for j in range(len(shape) + 1 - n + 2):
                    out[at + _slot(f"^{shape}$"[j : j + n], _SHAPE_DIMS)] = 1.0
    at += _SHAPE_DIMS
    out[at:] = (1.0, min(3.0, np.log1p(len(text)) / 2), len(words) < 8, text[:1].isupper())
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Bidirectional LSTM with a softmax over `LABELS`; gates are in the order input, forget, output, cell."""

    weights: dict[str, np.ndarray]
    threshold: float = 0.0
    report: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for side in "fb":
            w[f"x{side}"] = (rng.normal(0, 1, (INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)).astype(np.float32)
            w[f"h{side}"] = (rng.normal(0, 1, (HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            w[f"c{side}"] = bias
        w["o"] = (rng.normal(0, 1, (2 * HIDDEN + INPUT, len(LABELS))) / np.sqrt(2 * HIDDEN + INPUT)).astype(np.float32)
        w["p"] = np.zeros(len(LABELS), np.float32)
        return cls(w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        w, h, c = self.weights, np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        pre = x @ w[f"x{side}"] + w[f"c{side}"]
        out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(new_c)
            new_h = m * (o * th) + (1 - m) * h
            if keep:
                tape.append((t, i, f, o, g, c, h, th, m))
            h, c = new_h, new_c
            out[:, t] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return self._forward(x, mask, False)[0]

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list, list]:
        ahead, tape_f = self._pass(x, mask, "f", keep)
        back, tape_b = self._pass(x, mask, "b", keep)
        both = np.concatenate([ahead, back, x], 2)
        z = both @ self.weights["o"] + self.weights["p"]
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        return e / e.sum(2, keepdims=True), both, tape_f, tape_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, both, tape_f, tape_b = self._forward(x, mask, True)
        d = prob.copy()
        n, s = y.shape
        d[np.arange(n)[:, None], np.arange(s)[None, :], y] -= 1
        d *= (np.where(y == LABELS.index("residue"), RESIDUE_WEIGHT, 1.0) * mask)[:, :, None] / max(1.0, mask.sum())
        flat = both.reshape(-1, both.shape[2])
        grads = {"o": flat.T @ d.reshape(-1, len(LABELS)), "p": d.sum((0, 1))}
        to_hidden = d @ self.weights["o"].T
        for side, tape, part in (("f", tape_f, slice(0, HIDDEN)), ("b", tape_b, slice(HIDDEN, 2 * HIDDEN))):
            wh = self.weights[f"h{side}"]
            gx, gh = np.zeros_like(self.weights[f"x{side}"]), np.zeros_like(wh)
            gb = np.zeros(4 * HIDDEN, np.float32)
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, g, c, h, th, m in reversed(tape):
                dh = dh + to_hidden[:, t, part]
                inner = dh * m
                do = inner * th
                dc_all = dc * m + inner * o * (1 - th * th)
                z = np.concatenate([dc_all * g * i * (1 - i), dc_all * c * f * (1 - f), do * o * (1 - o), dc_all * i * (1 - g * g)], 1)
                gx += x[:, t].T @ z
                gh += h.T @ z
                gb += z.sum(0)
                dh = z @ wh.T + dh * (1 - m)
                dc = dc_all * f + dc * (1 - m)
            grads |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gb}
        return grads

    def label(self, documents: list[list[Leaf]]) -> list[np.ndarray]:
        """Class probabilities of every leaf; each document is one sequence, those of like length are read together."""
        out = [np.zeros((len(x), len(LABELS)), np.float32) for x in documents]
        order = sorted((d for d, x in enumerate(documents) if x), key=lambda d: len(documents[d]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * len(documents[order[hi]]) <= SLOTS:
                hi += 1
            x, mask = _padded([documents[d] for d in order[lo:hi]])
            prob = self.probabilities(x, mask)
            for r, d in enumerate(order[lo:hi]):
                out[d] = prob[r, : len(documents[d])]
            lo = hi
        return out


def _padded(runs: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(map(len, runs)))
    x, mask = np.zeros((len(runs), steps, INPUT), np.float32), np.zeros((len(runs), steps), np.float32)
    for r, run in enumerate(runs):
        for t, leaf in enumerate(run):
            x[r, t] = features(leaf)
            mask[r, t] = 1
    return x, mask


_PARTS = re.compile(r"\n+|(?<=[.!?]) +(?=[A-Z`*_\[{<\\$~&#>'])")


def summary_leaves(text: str, weak_labels: bool = False) -> list[Leaf]:
    """The sentences of a summary as leaves; the line's field name is the path.

    With weak labels a leaf that a mark of the whole text reaches into is residue, even
    if the mark began in another leaf.
    """
    spans = [m.span() for _, rule in _rules_for(text) for m in rule.finditer(text)] if weak_labels else []
    out, path, at = [], "summary", 0
    for gap in [*_PARTS.finditer(text), None]:
        end = gap.start() if gap else len(text)
        part = text[at:end]
        if m := re.match(r"([A-Z][A-Za-z ]{1,24}|ADR \d+):\s", part):
            path = "summary/" + re.sub(r"\d+", "n", m.group(1))
        if part.strip():
            out.append(Leaf(path, part, "residue" if any(a < end and b > at for a, b in spans) else "paragraph"))
        at = gap.end() if gap else end
    return out


def fit(documents: list[list[Leaf]], epochs: int = EPOCHS) -> Labeller:
    """Train on leaves whose guesses are the weak labels; a fifth of the documents is held out.

    The threshold for residue is the one that agrees best with the weak labels of the
    held-out documents (a document is residue if any leaf is); of several the middle one.
    """
    model = Labeller.fresh()
    runs = [d for d in documents if d]
    held, train = [r for n, r in enumerate(runs) if n % 5 == 4], [r for n, r in enumerate(runs) if n % 5 != 4]
    train.sort(key=len)
    batches = []
    for lo in range(0, len(train), BATCH):
        part = train[lo : lo + BATCH]
        x, mask = _padded(part)
        y = np.zeros(mask.shape, np.int64)
        for r, run in enumerate(part):
            y[r, : len(run)] = [LABELS.index(leaf.guess) for leaf in run]
        batches.append((x, mask, y))
    rng = np.random.default_rng(5)
    m1 = {k: np.zeros_like(v) for k, v in model.weights.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(epochs):  # Adam
        for b in rng.permutation(len(batches)):
            step += 1
            for k, g in model.gradients(*batches[b]).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model.weights[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    at, right, total, top, known = LABELS.index("residue"), 0, 0, [], []
    for run, prob in zip(held, model.label(held)):
        truth = np.array([LABELS.index(leaf.guess) for leaf in run])
        right, total = right + int((prob.argmax(1) == truth).sum()), total + len(run)
        top.append(float(prob[:, at].max()))
        known.append(bool((truth == at).any()))
    threshold, wrong = _best_threshold(np.array(top), np.array(known, bool))
    return Labeller(model.weights, threshold, {"runs": len(runs), "held_out_accuracy": right / total if total else None, "held_out_documents": len(held), "held_out_residue": sum(known), "held_out_wrong": wrong})


def _best_threshold(top: np.ndarray, known: np.ndarray) -> tuple[float, int]:
    """The probability that parts known residue from the rest with the fewest errors, and these; 0.5 without both kinds."""
    if not known.any() or known.all():
        return 0.5, int((known != (top >= 0.5)).sum())
    edges = np.concatenate([[0.0], np.sort(top), [1.0]])
    cuts = np.sqrt(np.maximum(edges[:-1], 1e-6) * np.maximum(edges[1:], 1e-6))
    wrong = np.array([((top >= c) != known).sum() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    return float(np.exp(np.log(cuts[best]).mean())), int(wrong.min())


def current_texts(parsed: DataFrame, column: str) -> DataFrame:
    """(repo, id, text) of live records' current rows, once each; records without a text are left out.

    Which revision counts is found from the key columns; texts are shuffled once.
    """
    current = parsed.groupBy("repo", "id").agg(F.max(F.struct("revision", (F.col("is_deleted") == F.lit(False)).alias("live"))).alias("c"))
    current = current.where("c.live").select("repo", "id", F.col("c.revision").alias("revision"))
    rows = parsed.where(F.length(column) > 0).select("repo", "id", "revision", F.col(column).alias("text"))
    return rows.join(current, ["repo", "id", "revision"], "left_semi").groupBy("repo", "id").agg(F.max("text").alias("text"))


def _sample(texts: DataFrame, most: int) -> list[str]:
    n = texts.count()
    share = int(min(1.0, most / max(1, n)) * 1_000_000) + 1
    drawn = texts.where(F.pmod(F.xxhash64("repo", "id", F.lit(3)), F.lit(1_000_000)) < share).limit(most).collect()
    return [r["text"] for r in sorted(drawn, key=lambda r: (r["repo"] or "", r["id"] or ""))]


def fit_summaries(texts: list[str], clean_share: int = CLEAN_SHARE) -> Labeller:
    """A labeller of summaries: fitted on all that have marks and ``clean_share`` times as many that have none.

    Clean ones with unusual words come first, as only they can be mistaken.
    """
    leaved = [summary_leaves(t, weak_labels=True) for t in texts]
    marked = [d for d in leaved if any(leaf.guess == "residue" for leaf in d)]
    clean = [d for d in leaved if d and not any(leaf.guess == "residue" for leaf in d)]
    unusual = [sum(_unusual(w) for leaf in d for w in leaf.text.split()) > 0 for d in clean]
    order = sorted(range(len(clean)), key=lambda i: not unusual[i])[: max(200, clean_share * len(marked))]
    mixed = [*marked, *(clean[i] for i in order)]
    return fit([mixed[i] for i in np.random.default_rng(9).permutation(len(mixed))])


def summaries_with_markup(parsed: DataFrame, sample: int = SAMPLE_SUMMARIES, model: Labeller | None = None) -> DataFrame:
    """(repo, id, marks): live records whose current summary still holds markup, with the kinds of it.

    The labeller reads every sentence of every summary; a record with a sentence whose
    residue probability reaches the threshold is one.  The kinds are named by rules;
    what none of them names is ``other``.  Null and empty summaries are no cases;
    repeated deliveries count once.
    """
    texts = materialize(current_texts(parsed, "summary_text"), "summaries")
    model = model or fit_summaries(_sample(texts, sample))
    held = parsed.sparkSession.sparkContext.broadcast(model)
    at = LABELS.index("residue")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                prob = held.value.label([summary_leaves(t) for t in part["text"]])
                hit = part[[bool(len(p)) and float(p[:, at].max()) >= held.value.threshold for p in prob]]
                yield pd.DataFrame({"repo": hit["repo"], "id": hit["id"], "marks": pd.Series([residue_marks(t) or ["other"] for t in hit["text"]], index=hit.index, dtype=object)})

    return spread(texts).mapInPandas(run, "repo string, id string, marks array<string>")


def clean_texts(parsed: DataFrame, column: str = "raw_content", sample: int = SAMPLE_RECORDS) -> DataFrame:
    """(repo, id, text, n_leaves, counts per label): clean text of live records' current rows.

    A leaf takes the label that the network finds most likely; where the path itself
    fixes one (code fences, comments, headings) and the network is less sure than 0.9,
    the path decides.  Records without a text give no row.
    """
    texts = materialize(current_texts(parsed, column), "texts")
    model = fit([leaves(t) for t in _sample(texts, sample)])
    held = parsed.sparkSession.sparkContext.broadcast(model)
    schema = "repo string, id string, text string, n_leaves int, " + ", ".join(f"n_{k} int" for k in LABELS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                docs = [leaves(t) for t in part["text"]]
                rows = []
                for repo, id_, doc, prob in zip(part["repo"], part["id"], docs, held.value.label(docs)):
                    for leaf, p in zip(doc, prob):
                        best = int(p.argmax())
                        leaf.label = LABELS[best] if p[best] >= 0.9 and leaf.guess == "paragraph" else leaf.guess
                    used = [leaf.label for leaf in doc]
                    rows.append((repo, id_, render(doc), len(doc), *(used.count(k) for k in LABELS)))
                yield pd.DataFrame(rows, columns=["repo", "id", "text", "n_leaves", *(f"n_{k}" for k in LABELS)])

    return spread(texts).mapInPandas(run, schema)


def clean_summaries(parsed: DataFrame) -> DataFrame:
    """(repo, id, text, marks): clean summary of live records' current rows, with the kinds of markup that it had.

    Every summary is checked exactly, so no labeller is needed.  Records without a
    summary give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"repo": pdf["repo"], "id": pdf["id"], "text": [clean_summary(t) for t in pdf["text"]], "marks": [residue_marks(t) for t in pdf["text"]]})

    return current_texts(parsed, "summary_text").mapInPandas(run, "repo string, id string, text string, marks array<string>")
