"""Template residue and error-page text: records that hold what a broken tool left instead of real content.

Phrases of error pages, filler and script notices in many languages are matched by one automaton in one pass
over the folded text; words that prose has as well count only near a phrase that counts by itself. A document is a case when the matches cover at least ``COVERAGE`` of its body: of what is left without
title, headings, categories, templates, tags and an opening, or of the frame's own text if nothing else is left. Pages that quote such
messages have a body of other sentences and stay far below.

Unfilled placeholders count one by one: one in the page's own sentences or infobox is enough. Placeholders shown
as code, and sentences that speak of placeholders, don't count.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm import phrases

#: Share of a body's characters from which it is residue.
COVERAGE = 0.3
#: A smaller share of the body than this counts as none: single words that messages and prose have in common.
LEAST = 0.03
#: An opening is a title in bold with a sentence, or a paragraph of at most so many.
OPENING = 2
#: Characters within which a part of a message is near it.
NEAR = 40

#: Letters of other scripts, and below them the Latin ones that they look like.
LOOKALIKES = str.maketrans(
    "οаеорсухіνκ",
    "oaeopcyxivk",
)
_MIXED = re.compile("(?<=[a-z])[οаеорсухіνκ]+|[οаеорсухіνκ]+(?=[a-z])")
#: Signs that stand for others, and signs that are not seen.
SIGNS = {"ł": "l", "ø": "o", "đ": "d", "ı": "i", "ß": "ss", "\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\ufeff": " ", "\u200b": "", "\u00ad": ""}
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u3099\u309a]+")
_SPACE = re.compile(r"\s+")

#: The characters of the bytes 0x80 to 0xFF in Windows-1252, bytes without one standing for themselves.
_BYTE_OF = {bytes((b,)).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)}
_MISREAD = re.compile("[" + re.escape("".join(c for c, b in _BYTE_OF.items() if b >= 0xC2)) + "][" + re.escape("".join(c for c, b in _BYTE_OF.items() if b < 0xC0)) + "]{1,3}")


def _reread(found: re.Match) -> str:
    try:
        return bytes(_BYTE_OF[c] for c in found[0]).decode("utf-8")
    except UnicodeDecodeError:
        return found[0]


def fold(text: str) -> str:
    """Lower case, entities resolved, UTF-8 that was read as Windows-1252 read again, accents off, look-alike letters within Latin words made Latin."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MISREAD.sub(_reread, text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        for sign, plain in SIGNS.items():
            text = text.replace(sign, plain)
        text = _MIXED.sub(lambda m: m[0].translate(LOOKALIKES), text)
    return text


def status_lines() -> list[str]:
    """Codes of errors with their reason, or beside a word for an error."""
    out = []
    for code, reason in phrases.STATUS.items():
        out += [f"{code} {reason}", f"{code} - {reason}", f"{code}: {reason}", *[x for w in phrases.ERROR_WORDS for x in (f"{w} {code}", f"{code} {w}", f"{w}: {code}", f"{w}{code}")]]
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases, folded, with their length and whether they count by themselves."""
    found = ahocorasick.Automaton()
    own = {_SPACE.sub(" ", fold(p)) for p in (*phrases.ERRORS, *phrases.FILLERS, *phrases.SCRIPTS, *status_lines())}
    for phrase in own | {_SPACE.sub(" ", fold(p)) for p in phrases.PARTS}:
        found.add_word(phrase, (len(phrase), phrase in own))
    found.make_automaton()
    return found


def matched(folded: str) -> int:
    """Characters of a folded text, its blanks single, that lie in some phrase; of phrases that overlap each character counts once. A phrase in Latin letters is whole words.

    A part counts if at most ``NEAR`` characters are between it and something that counts.
    """
    spans, alone = [], False
    for end, (length, own) in automaton().iter(folded):
        start = end - length + 1
        if (start and folded[start].isalnum() and folded[start - 1].isalnum() and folded[start].isascii()) or (end + 1 < len(folded) and folded[end].isalnum() and folded[end + 1].isalnum() and folded[end].isascii() and folded[end + 1].isascii()):
            continue
        spans.append((start, end, own))
        alone |= own
    if not alone:
        return 0
    spans.sort()
    counts = [own for _, _, own in spans]
    last = -NEAR - 2
    for i, (start, end, _) in enumerate(spans):
        counts[i] |= start - last - 1 <= NEAR
        if counts[i]:
            last = max(last, end)
    following = len(folded) + NEAR + 2
    for i in range(len(spans) - 1, -1, -1):
        start, end, _ = spans[i]
        counts[i] |= following - end - 1 <= NEAR
        if counts[i]:
            following = min(following, start)
    total, end_before = 0, -1
    for (start, end, _), kept in zip(spans, counts, strict=True):
        start = max(start, end_before + 1)
        if kept and end >= start:
            total += end - start + 1
            end_before = end
    return total


_LATIN_WORD = re.compile(r"[a-z]+")


def latin(folded: str) -> int:
    """Characters of Latin filler: all its words, if there are at least four different ones and they are most of the words."""
    words = _LATIN_WORD.findall(folded)
    own = [w for w in words if w in phrases.LATIN]
    if len(set(own)) < 4 or 2 * len(own) < len(words):
        return 0
    return sum(map(len, own)) + len(own)


_NOTES = r"<!--.*?-->|<!doctype[^>]*>|<ref\b[^>/]*>.*?</ref>|<gallery\b.*?</gallery>|^\s*=+[^=\n]+=+\s*$|\[\[[^\[\]:|]{1,20}:[^\[\]]*\]\]|__[a-z]+__|<\|[a-z]+\|>"
_FRAME = re.compile(rf"{_NOTES}|<head\b.*?</head>|<h\d\b[^>]*>.*?</h\d>|<address\b.*?</address>|<(pre|nowiki|code|syntaxhighlight|source|math)\b[^>]*>.*?</\1>|\{{\|.*?\n\|\}}", re.S | re.M)
#: The frame of a page whose message is in its headings, head, tables or preformatted text.
_THIN_FRAME = re.compile(rf"{_NOTES}|<(style|script)\b[^>]*>.*?</\1>", re.S | re.M)
_TAGS = re.compile(r"</?[a-z!?][^<>]*>")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_BLANK_LINES = re.compile(r"\n\s*\n")
_MARKUP = re.compile(r"'{2,}|\[\[|\]\]")


_SENTENCE = re.compile(r"\n|[.。!?]\s")
_LINE_END = re.compile(r"[.。!?][ \t]*\n")
_SERVER = re.compile(rf"(?:{'|'.join(map(re.escape, phrases.SERVERS))})(?:[/ ][\w.+-]+)?(?: \([^()]*\))?(?: server)?(?: at \S+)?(?: port \d+)?")


_ABBREVIATED = re.compile(r"(?:^|[\s(.])\w{1,2}\.\s$")


def _ends(text: str) -> list[int]:
    """Where the sentences of a text end; a full stop after one or two letters is none."""
    return [m.end() for m in _SENTENCE.finditer(text) if not _ABBREVIATED.search(text[max(0, m.end() - 5) : m.end()])]


def _said(text: str) -> list[str]:
    """What a text whose frame is off may be taken to say, blanks single. A first paragraph that begins with a title in bold goes but for what is residue by itself: its first sentence, what comes before the end of a line, or all of it if it has at most ``OPENING`` sentences."""
    paragraphs = [p.strip() for p in _BLANK_LINES.split(_TAGS.sub(" ", text))]
    paragraphs = [p for p in paragraphs if p]
    clean = lambda p: _SPACE.sub(" ", _MARKUP.sub("", p)).strip(" \t*#:;")
    heads = [""]
    if paragraphs and paragraphs[0].startswith("'''"):
        title = re.match(r"'''.*?'''\s*", paragraphs[0], re.S)
        rest = paragraphs[0][title.end() :] if title else paragraphs[0]
        paragraphs = paragraphs[1:]
        first, ends = clean(rest), _ends(rest)
        if first and 2 * (matched(first) + latin(first)) >= len(first):
            heads = [rest]
        else:
            short = len([end for end in ends if rest[end:].strip()]) < OPENING
            cuts = [*ends[:1], *[m.end() for m in _LINE_END.finditer(rest) if len([end for end in ends if end <= m.end()]) <= OPENING]]
            heads = [*[rest[end:] for end in cuts], *([""] if short else [])] or [rest]
    return [" ".join(x for x in map(clean, [head, *paragraphs]) if x) for head in heads]


def bodies(folded: str) -> list[str]:
    """What a folded text may be taken to say besides its frame. If that is nothing or a server's name, the message may be in the frame: in headings, head, tables and preformatted text, or else in anything but tags."""
    found: list[str] = []
    for frame in (_FRAME, _THIN_FRAME, None):
        text = frame.sub("\n\n", folded) if frame else folded
        while frame and (shorter := _TEMPLATE.sub("", text)) != text:
            text = shorter
        found += _said(text)
        if found[-1] and not _SERVER.fullmatch(found[-1]):
            break
    return [x for x in found if x]


def coverage(folded: str) -> float:
    """Share of the body that is residue; 0 for an empty body and for a share under ``LEAST``. The frame, however long, has no part in it."""
    share = max((min(1.0, max(matched(own), latin(own)) / len(own)) for own in bodies(folded)), default=0.0)
    return share if share >= LEAST else 0.0


_WORD = r"[^\W\d_][\w.-]*"
_WORDS = rf"{_WORD}(?:[ ]{_WORD})*"
_PLACEHOLDER = re.compile(
    rf"""[{{$%<@\#x\[p_](?:
      (?<=\{{)\{{\{{\s*{_WORDS}\s*(?:\|[^{{}}|\n]*)?\}}\}}\}} | (?<=\$)\{{\s*{_WORDS}\s*\}} | (?<=\$){_WORD}\$ | (?<=%)\({_WORDS}\)[sd] | (?<=%){_WORD}% | (?<=<)%=?\s*{_WORDS}\s*%> | (?<=@)@{_WORD}@@ | (?<=\#){_WORD}\# |
      (?<=x)x[^\W\dx_]\w*?xx | (?<=\[)(?:insert|your|enter|add)\ [^\[\]\n]+\ here\] | (?<=\{{)\{{\s*\w+\.\w+\s*\}}\}} | (?<=p)laceholder_\w+ |
      (?<=<)(?P<tag>{_WORD})> | (?<=\[)(?P<bracket>{_WORDS})\](?!\() | (?<=\{{)(?P<brace>{_WORD})\}}(?!\}}) | (?<=_)_(?P<under>[^\W_](?:\w*?[^\W_])?)__)""",
    re.X,
)
_FIELDS, _MENTIONS = frozenset(map(fold, phrases.FIELDS)), tuple(map(fold, phrases.MENTIONS))
_CODE = re.compile(r"<(pre|nowiki|code|syntaxhighlight|source|math)\b[^>]*>.*?</\1>|<!--.*?-->", re.S)
#: A capital letter begins what is in the brackets, which stand by themselves.
_CAPITAL = re.compile(r"(?<![\[\w])\[([^\W\d_a-z][^\[\]\n|]*)\](?![\](\w])")


def _capitals(text: str) -> set[str]:
    """What a text has in square brackets that begin with a capital letter and hold at most three words, none of them an editor's, folded."""
    found = set()
    for m in _CAPITAL.finditer(html.unescape(text)):
        words = fold(m[1]).split()
        if m[1][0].isupper() and len(m[1]) > 2 and len(words) <= 3 and not phrases.EDITORIAL & set(words):
            found.add(" ".join(words))
    return found


def placeholders(folded: str, text: str = "") -> int:
    """Unfilled placeholders of a folded text, those aside that are shown as code or spoken about. text: the text before it was folded, in which capitals show."""
    if not _PLACEHOLDER.search(folded):
        return 0
    folded = _CODE.sub(" ", folded)
    template_page = "<noinclude" in folded or "{{documentation}}" in folded
    capitals = _capitals(text) if "[" in text else set()
    count, ends = 0, None
    for m in _PLACEHOLDER.finditer(folded):
        before, after = folded[m.start() - 1 : m.start()], folded[m.end() : m.end() + 1]
        if m["tag"]:
            listed = m["tag"] in _FIELDS or re.fullmatch(r"field\d+", m["tag"])
            if not listed and (len(m["tag"]) < 3 or m["tag"] in phrases.TAGS or "." in m["tag"] or before.isalnum() or f"</{m['tag']}" in folded):
                continue
        elif m["bracket"]:
            if m["bracket"] not in _FIELDS and m["bracket"] not in capitals and not re.fullmatch(r"field\d+", m["bracket"]):
                continue
            if before == "[" and after == "]" and folded[m.start() - 2 : m.start()] != "[[":
                continue
        elif m["under"] and (m["under"] in phrases.SWITCHES or m["under"][::-1] in phrases.SWITCHES):
            continue
        elif m["brace"] and before in ("{", "$", "_", "^", "}", "\\"):
            continue
        elif template_page and m[0].startswith("{{{"):
            continue
        if ends is None:
            ends = [s.end() for s in _SENTENCE.finditer(folded)]
        at = bisect_right(ends, m.start())
        to = bisect_right(ends, m.end())
        sentence = folded[ends[at - 1] if at else 0 : ends[to] if to < len(ends) else len(folded)].replace(m[0], " ")
        if any(x in sentence for x in _MENTIONS):
            continue
        count += 1
    return count


def judge(text: str | None) -> tuple[int, float]:
    """Placeholders and coverage of a text; (0, 0.0) for null, empty and blank ones."""
    if not text or text.isspace():
        return 0, 0.0
    folded = fold(text)
    return placeholders(folded, text), coverage(folded)


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, n_placeholders, coverage and is_residue of each row of documents (doc_id, text); other columns are ignored.

    Null, empty and blank texts are no residue. Rows are neither dropped nor joined. One pass without shuffle over
    whole texts.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(None if b is None else b.decode("utf-8", "replace")) for b in batch.column(1).to_pylist()]
            count, share = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int32()), pa.array(share, pa.float64()), pa.array([n > 0 or s >= COVERAGE for n, s in found], pa.bool_())], names=["doc_id", "n_placeholders", "coverage", "is_residue"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(each, f"doc_id {kind}, n_placeholders int, coverage double, is_residue boolean")


def clean(documents: DataFrame) -> DataFrame:
    """documents without the rows that are residue, all columns and all other rows kept as they are. One pass: texts are judged where they are read, and nothing is shuffled."""
    at = documents.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(at).to_pylist():
                n, share = judge(text)
                keep.append(n == 0 and share < COVERAGE)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(each, documents.schema)
