"""Keyword-stuffed and link-list pages (problem 9) by block-wise compression ratio.

A document is reduced to its body: commit header, subject, file headers and hunk marks are left out. Disguises
are undone (zero-width characters, letters set apart by dots, digits for letters). The body's lines are sorted
by their form alone: sentences, code or data, links with a short anchor, runs of tags, and plain phrases. Two
blocks are compressed, the listing (links and tags, as they stand) and the phrases (their words). Each ratio is compared
with the ratio usual for its length and language, which is a statistic over the whole corpus: a listing must be no less
redundant than text usually is, phrases extremely redundant. Either counts only if the text of the document is
poor in sentence punctuation, measured as sentence ends a word. A document is a case when what
passes both tests makes up the greater part of its body; no line counts by its form alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sdlweave.runtime import spread, stage

_ZERO = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_DOTTED = re.compile(r"(?<![\w.])\w(?:\.\w)+(?![\w.])")
_LEET = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"(?<![\w./@$-])(?:[a-zA-Z]+[013457@$]|[013457@$]+[a-zA-Z])[a-zA-Z013457@$]*(?![\w./@$-])")
_HEADER = re.compile(r"(?:commit [0-9a-f]{7,}|From [0-9a-f]{40} |Author: |AuthorDate: |Commit: |CommitDate: |Date: |From: |Merge: |Subject: |by \S+ in \S+/\S+\s*$|(?:Co-authored|Signed-off|Reviewed)-by: )")
_FILE = re.compile(r"(?:diff --git |index [0-9a-f]+\.\.|--- (?:a/|/dev/null)|\+\+\+ (?:b/|/dev/null)|(?:new|deleted) file mode |old mode |new mode |similarity index |rename |copy |Binary files |GIT binary patch)")
#: With a scheme, or a name with a path.
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w./@-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?=/)[^\s<>\"')\]]*", re.I)
_TAG = re.compile(r"(?<![\w&/])#[^\W\d_]\w*")
_MARKUP = re.compile(r"</?[a-zA-Z][^>]*>|\[|\]\(|\)|&\w+;")
_META = re.compile(r"<meta\b[^>]*\bcontent=[\"']?([^\"'>]*)", re.I)
#: A word or two and a colon before a list.
_LABEL = re.compile(r"^\s*[^\W\d_]+(?:[ -][^\W\d_]+)?\s*[:：]\s*(?=[^,;、|]*(?:[,;、|][^,;、|]+){2})")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^\W\d_]{2,}[\"')\]]*[.!?。！？](?=\s|$|[\"')\]])|[。！？]")
_CODE = re.compile(r"""[{}();=<>\\`$@^*_\[\]]|[\w"'\])]:\s|\w:$|::|->|=>|//|^\s*(?:\#|--)\s""")
#: Signs of code that no later step removes, and the stops without which nothing is a sentence.
_HARD = re.compile(r"[{}()=\\`$@^*_]")
_STOPS = re.compile("[.!?。！？]")
_DECOR = re.compile(r"(?:!{2,}|>{2,}|→|[★✔💯🔥☆✓•·|/,;~–—-])+")
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_KEYED = re.compile(r"^\s*[\w-]+[\s:=]+[\"']")
_COUNT = re.compile(r"\d+ file")
_VERSION = re.compile(r"\s*\d+(?:\.\d+)+")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d|\d\d:\d\d")

#: Most words of anchor text beside a link, share of a line's characters in tags, least words of a phrase line.
ANCHOR_WORDS, TAG_SHARE, PHRASE_WORDS = 8, 0.6, 2
#: Most of the usual ratio of its length and language that a block of phrases and a listing of links and tags may have.
EXTREME, REDUNDANT = 0.7, 1.1
#: Most sentence ends a word of the document's text, links aside: one in 20 words, where prose has about one in 12.
DENSITY = 0.05
#: Part of the body that must be links, tags or confirmed phrases; least characters of these and of a block.
GREATER_PART, LEAST_CHARS = 0.5, 80
#: The usual ratio of a length is this quantile of the corpus' prose blocks: spam can't move it while it is under three quarters.
USUAL, LEAST_PROSE = 0.75, 32
#: Documents of all languages that weigh in each language's factor: with few of its own it is close to 1.
LEAST_DOCS = 100
LANGUAGES = ("en", "de", "fr", "es", "ja")


def plain(text: str) -> str:
    """The text with disguises undone."""
    if not text.isascii():
        text = _SPACES.sub(" ", _ZERO.sub("", text))
    text = _DOTTED.sub(lambda m: m.group().replace(".", ""), text)
    return _MIXED.sub(lambda m: m.group().translate(_LEET), text)


def body(text: str) -> list[tuple[str, bool]]:
    """Lines of message and changes, and whether they are new; headers, subject, file headers and hunk marks are left out."""
    out: list[tuple[str, bool]] = []
    in_diff = subject = mail = False
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if _FILE.match(line) or line.startswith("@@"):
            in_diff = True
        elif in_diff:
            if line[:2] == "--" and line.rstrip() == "--" and _signed(lines[i + 1 :]):
                break
            out.append((line[1:] if line[:1] in "+- " else line, line[:1] == "+"))
        else:
            s = line.strip()
            mail = mail or s.startswith("Subject: ")
            if not s or s in ("---", "--") or _HEADER.match(s) or _COUNT.match(s):
                subject = subject or mail
            elif not subject:  # the first line that is no header
                subject = True
            else:
                out.append((s, True))
    return out


def _signed(rest: list[str]) -> bool:
    """Whether what follows ``--`` ends the text as a mail's signature: a version line, and no more of a diff."""
    rest = [x for x in rest if x.strip()]
    return not rest or bool(_VERSION.match(rest[0])) and not any(x.startswith(("+", "@@")) or _FILE.match(x) for x in rest[1:])


def kind(line: str) -> tuple[str, str]:
    """What a line is built of: sentence, code, link, tag, phrase or none, and its bare words."""
    s = line.strip()
    if not s:
        return "none", ""
    has_dot, marked = "." in s, "<" in s or "[" in s or "&" in s
    meta = _META.search(s) if "<" in s else None
    if meta:
        s = meta.group(1)
        has_dot, marked = "." in s, "<" in s or "[" in s or "&" in s
    label = _LABEL.match(s) if ":" in s or "：" in s else None
    if label:
        s = s[label.end() :]
    tags = _TAG.findall(s) if "#" in s else None
    if tags and sum(map(len, tags)) >= TAG_SHARE * len(s.replace(" ", "")):
        return "tag", " ".join(tags)
    links = _URL.findall(s) if has_dot else None
    if not links and not marked and _HARD.search(s):  # most lines of a change end here
        return ("sentence" if _STOPS.search(s) and _SENTENCE.search(s) or _STAMP.search(s) else "code"), ""
    bare = _MARKUP.sub(" ", _URL.sub(" ", s) if links else s)
    bare = _DECOR.sub(" ", _BULLET.sub("", bare))
    words = _WORD.findall(bare)
    if _STOPS.search(bare) and _SENTENCE.search(bare) or _STAMP.search(bare):
        return "sentence", ""
    if links and not _KEYED.match(s):
        covered = sum(map(len, links))
        if len(words) <= ANCHOR_WORDS and covered * 2 >= len(re.sub(r"\s", "", bare)):
            return "link", " ".join(words)
    if _CODE.search(bare):
        return "code", ""
    if len(words) >= PHRASE_WORDS:
        return "phrase", " ".join(words).lower()
    return "code", ""


def _ratio(lines: list[str]) -> tuple[float, int]:
    """Compression ratio and bytes of a block; the stream's fixed cost is taken off."""
    block = "\n".join(lines).encode("utf-8", "replace")
    return ((len(zlib.compress(block, 6)) - 8) / len(block) if block else 1.0), len(block)


def profile(text: str) -> tuple:
    """Characters of the body and of its links, tags and phrases; ratio and bytes of the listing, the phrases and all prose; sentence ends and words."""
    chars: Counter = Counter()
    listing: list[str] = []
    phrases: list[str] = []
    prose: list[str] = []
    ends = count = 0
    for line, new in body(plain(text)):
        k, words = kind(line)
        s = line.strip()
        chars[k] += len(s)
        if k in ("none", "code") or not new:
            continue
        if k in ("link", "tag"):
            listing.append(s)
        else:
            prose.append(s)
            if k == "phrase":
                phrases.append(words)
        text_only = _URL.sub(" ", s) if "." in s else s
        ends += len(_SENTENCE.findall(text_only)) if _STOPS.search(text_only) else 0
        count += len(_WORD.findall(s))
    return sum(chars.values()), chars["link"], chars["tag"], chars["phrase"], *_ratio(listing), *_ratio(phrases), *_ratio(prose), ends, count


_COLUMNS = {"body": "long", "link": "long", "tag": "long", "phrase": "long", "list_ratio": "double", "list_block": "long", "ratio": "double", "block": "long", "prose_ratio": "double", "prose": "long", "ends": "long", "words": "long"}
_SHAPE = "doc_id long, lang string, " + ", ".join(f"{n} {k}" for n, k in _COLUMNS.items())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.float64() if k == "double" else pa.int64() for k in _COLUMNS.values()]
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            rows = [profile(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", "lang", *_COLUMNS])


def profiles(docs: DataFrame) -> DataFrame:
    """Staged measures of every document with a text."""
    code = F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2))
    lang = F.when(code.isin(*LANGUAGES), code).otherwise("other")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", lang.alias("lang"), "text")
    return stage(spread(texts).mapInArrow(_profile, _SHAPE))


def _usual(table: dict[int, float], length):
    """The usual ratio at a length, between the two nearest powers of two; a column expression."""
    if not table:
        return F.lit(1.0)
    filled = [table[min(table, key=lambda k, n=n: abs(k - n))] for n in range(64)]
    x = F.log2(F.greatest(length, F.lit(LEAST_PROSE)).cast("double")) - 0.5
    low = F.floor(x).cast("int")
    at = F.array(*[F.lit(v) for v in filled])
    a, b = F.get(at, low), F.get(at, low + 1)
    return a + (b - a) * (x - low)


def _factor(own: float, count: int) -> float:
    """A language's factor from its own and the 1 of all, by its count of documents."""
    return (own * count + LEAST_DOCS) / (count + LEAST_DOCS)


def spam(docs: DataFrame) -> DataFrame:
    """``doc_id, share, redundancy, listing, density`` of the documents that are spam.

    ``share`` is the part of the body in confirmed links, tags and phrases, ``redundancy`` and ``listing`` the ratios of
    the phrases and of the listing over the usual ones, ``density`` the sentence ends a word. Null, empty and blank texts are none.
    """
    p = profiles(docs)
    prose = p.filter(F.col("prose") >= LEAST_PROSE)
    by_length = {r["k"]: r["q"] for r in prose.groupBy(F.floor(F.log2("prose")).cast("int").alias("k")).agg(F.percentile_approx("prose_ratio", USUAL).alias("q")).collect()}  # a row a power of two
    off = F.col("prose_ratio") / _usual(by_length, F.col("prose"))
    by_lang = {r["lang"]: (r["m"], r["n"]) for r in prose.rollup("lang").agg(F.percentile_approx(off, 0.5).alias("m"), F.count(F.lit(1)).alias("n")).collect()}  # a row a language, and one for all
    centre = by_lang.get(None, (1.0, 0))[0] or 1.0
    factors = {k: _factor(m / centre, n) for k, (m, n) in by_lang.items() if k is not None}
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in factors.items() for x in kv]), F.col("lang")), F.lit(1.0)) if factors else F.lit(1.0)
    over = lambda ratio, block: F.when(F.col(block) > 0, F.col(ratio) / (_usual(by_length, F.col(block)) * factor))
    measured = p.withColumns({"redundancy": over("ratio", "block"), "listing": over("list_ratio", "list_block"), "density": F.col("ends") / F.greatest(F.col("words"), F.lit(1))})
    held = lambda measure, most, block, chars: F.when((F.col(measure) <= most) & (F.col(block) >= LEAST_CHARS), chars).otherwise(0)
    found = held("redundancy", EXTREME, "block", F.col("phrase")) + held("listing", REDUNDANT, "list_block", F.col("link") + F.col("tag"))
    cases = measured.withColumn("found", found).filter((F.col("density") <= DENSITY) & (F.col("found") >= LEAST_CHARS) & (F.col("found") > GREATER_PART * F.col("body")))
    return cases.select("doc_id", (F.col("found") / F.col("body")).alias("share"), "redundancy", "listing", "density")
