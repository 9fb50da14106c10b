"""Main text of web pages by the best contiguous region.

A page is a sequence of tags and words. Words score by where they stand, tags are
negative; the weights are log odds of lying inside the article, counted over pages
that mark it (``article`` or ``main``). One linear scan finds the contiguous region
of the largest sum. Menus, adverts and the like inside the region are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylink.session import materialize

# What is not a tag with quotes; a tag whose quotes do not close ends at the next ">".
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|</?[a-zA-Z][^<>]*>|[^<]+|<", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^\s/<>]*")
_STOP = re.compile(r"""["'<>]""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_OTHER = re.compile(r"""(?<![^\s"'<>/=])(?!(?:class|id|role|style)[\s=])[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*')""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>=/])|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Elements whose text is never shown as text; their content is not parsed.
RAW = frozenset("script style title textarea noscript template iframe svg math object select".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements and words of class, id or role that mark what is not the article.
APART = frozenset("nav header footer aside form button menu dialog".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer masthead topbar comment comments respond disqus cookie cookies consent gdpr notice notices notification alert popup modal"
    " overlay newsletter subscribe signup paywall share sharing social related recommended widget login search pagination pager".split()
)
APART_IN_ARTICLE = frozenset("comment comments related recommended teaser promo ad ads sponsored".split())
_HEADS = frozenset(("site-header", "page-header", "header", "main-header", "top-header"))
_NEVER_APART = frozenset("html body".split())
_ARTICLE = frozenset("article main".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre figcaption article main section div body".split())

# Tag names of HTML, obsolete ones included: their counts are always collected.
HTML_TAGS = RAW | VOID | INLINE | APART | _NEVER_APART | _ARTICLE | _BLOCKS | frozenset(
    "address applet audio basefont bgsound canvas caption center col colgroup datalist details dir dl fieldset frame frameset head hgroup image isindex"
    " keygen legend listing marquee menuitem meter nobr noembed noframes ol optgroup option output param picture plaintext progress rb rtc search"
    " selectedcontent slot spacer summary table tbody tfoot thead tr ul video xmp".split()
)
_FIXED = sorted({f"t:{end}{t}" for t in HTML_TAGS for end in ("", "/")})

# Counts (inside, outside) added to what is seen, so that unseen kinds have a weight.
_PRIOR = {"w:a": (1.0, 4.0), "w:body": (2.0, 1.0), "w:div": (3.0, 1.0), "w:li": (2.0, 1.0)}
_PRIOR_WORD, _PRIOR_TAG = (4.0, 1.0), (1.0, 1.5)
LEAST_TAG = -0.02


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """End of the tag at ``at``, at the first ">" outside quotes of any length; -1 if there
    is no tag, or a "<" or the end of the page comes before that.

    ``dead``: opening quotes of this page from which no tag ends. Each is followed once,
    so the time is linear on broken pages too.
    """
    m = _TAG.match(html, at)
    if not m:
        return -1
    opened = []
    stop = _STOP.search(html, m.end())
    while stop and stop[0] not in "<>" and stop.start() not in dead:
        opened.append(stop.start())
        close = html.find(stop[0], stop.end())
        stop = _STOP.search(html, close + 1) if close >= 0 else None
    if stop and stop[0] == ">":
        return stop.end()
    dead.update(opened)
    return -1


def _is_apart(tag: str, name: str, inside_article: bool) -> bool:
    """Whether an opening tag starts something that is not the article."""
    if name in _NEVER_APART:
        return False
    if name in APART:
        return not (name == "header" and inside_article)
    tag = _OTHER.sub(" ", tag)  # what values of other attributes hold marks nothing
    if _HIDDEN.search(tag):
        return True
    for found in _MARKS.finditer(tag):
        marks = (found[1] or found[2] or found[3] or "").lower()
        if name not in _ARTICLE and _HEADS & set(marks.split()):
            return True
        words = re.split(r"[^a-z0-9]+", marks)
        bad = APART_IN_ARTICLE if name in _ARTICLE else APART_WORDS
        for before, word in zip(["", *words], words):
            if word in bad and before not in ("no", "has", "with", "without"):
                return True
    return False


def pieces(html: str) -> list[tuple[str, str | None, bool, bool]]:
    """(kind, text or None for a tag, breaks a block, lies in the marked article) of
    every tag and text of a page; comments and raw elements are left out."""
    out = []
    at, size = 0, len(html)
    apart, depth = None, 0  # the element that stands apart, and how often it is open
    block, link, article = "body", 0, 0
    dead: set[int] = set()
    while at < size:
        end = _tag_end(html, at, dead)
        if end < 0:
            end = _PIECE.match(html, at).end()
        piece, at = html[at:end], end
        if piece[0] != "<" or piece == "<":
            if not piece.isspace():
                kind = "w:apart" if apart else "w:a" if link else f"w:{block}"
                out.append((kind, piece, False, article > 0))
            elif out and out[-1][1] is not None:
                out.append(("w:space", piece, False, article > 0))
            continue
        if piece[1] in "!?":
            continue
        name = _NAME.match(piece)[1].lower()
        closing = piece[1] == "/"
        if name in RAW and not closing:
            if not piece.endswith("/>") or name in ("script", "style", "title", "textarea"):
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else size
            out.append((f"t:{name}", None, name not in INLINE, article > 0))
            continue
        if name in _ARTICLE:
            if closing:
                out.append((f"t:/{name}", None, True, article > 1))
                article = max(article - 1, 0)
                if not (apart and apart == name and depth > 1):
                    apart = None
                continue
            article += 1
            if apart and not _is_apart(piece, name, True):
                apart = None
        was_apart = apart is not None
        if apart:
            if name == apart:
                depth += -1 if closing else 1
                if not depth:
                    apart = None
            elif closing and name in _NEVER_APART:
                apart = None
        elif not closing and name not in VOID and _is_apart(piece, name, article > 0):
            apart, depth = name, 1
        if name == "a":
            link = 0 if closing else 1
        elif name in _BLOCKS:
            block, link = ("body" if closing else name), 0
        kind = "t:apart" if apart or was_apart else f"t:{'/' if closing else ''}{name}"
        out.append((kind, None, name not in INLINE, article > 0))
    return out


def counted(html: str) -> Counter:
    """Words and tags by (kind, inside the marked article) of a page that marks one
    article; nothing of other pages."""
    rows = pieces(html)
    if not any(r[3] for r in rows):
        return Counter()
    out: Counter = Counter()
    for kind, text, _, inside in rows:
        if kind != "w:space":
            out[kind, inside] += 1 if text is None else len(text.split())
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind of lying inside; tags are at most ``LEAST_TAG``. What stands
    apart is left out wherever it is, so crossing it costs no more than a tag does."""
    out = {"w:apart": LEAST_TAG, "t:apart": LEAST_TAG}
    for kind in ({k for k, _ in counts} | set(_PRIOR)) - set(out):
        more, less = _PRIOR.get(kind, _PRIOR_WORD if kind[0] == "w" else _PRIOR_TAG)
        out[kind] = math.log((counts.get((kind, True), 0) + more) / (counts.get((kind, False), 0) + less))
        if kind[0] == "t":
            out[kind] = min(out[kind], LEAST_TAG)
    return out


_DEFAULT = {"w": math.log(_PRIOR_WORD[0] / _PRIOR_WORD[1]), "t": math.log(_PRIOR_TAG[0] / _PRIOR_TAG[1])}


def main_text(html: str, weights: dict[str, float]) -> str:
    """Text of the maximum-scoring region; of equal ones the first."""
    rows = pieces(html)
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, (kind, text, _, _) in enumerate(rows):
        if kind == "w:space":
            continue
        total += weights.get(kind, _DEFAULT[kind[0]]) * (1 if text is None else len(text.split()))
        if total <= 0.0:
            total, start = 0.0, k + 1
        elif total > best:
            best, region = total, (start, k + 1)
    blocks, own = [], []
    for kind, text, breaks, _ in rows[slice(*region)]:
        if text is not None and kind != "w:apart":
            own.append(text)
        elif breaks and own:
            blocks.append("".join(own))
            own = []
    blocks.append("".join(own))
    words = (" ".join(unescape(b).split()) for b in blocks)
    return " ".join(w for w in words if w)


def trained(pages: DataFrame) -> dict[str, float]:
    """Weights from all ``pages`` (html) that mark their article. Kinds are tag names;
    those of HTML are counted in full. Rare invented ones could be many: those seen on
    fewer than 1 page in 10,000 keep the weight of an unseen tag, which bounds what is
    collected."""
    schema = pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64()), ("pages", pa.int64())])

    def run(batches):
        total, seen, pages_seen = Counter(), Counter(), 0
        for batch in batches:
            for html in batch.column(0).to_pylist():
                own = counted(html or "")
                total.update(own)
                seen.update(own.keys())
                pages_seen += bool(own)
            if len(total) > 10_000:
                yield flush(total, seen, 0)
                total, seen = Counter(), Counter()
        yield flush(total, seen, pages_seen)

    def flush(total, seen, pages_seen):
        rows = [(k, i, n, seen[k, i]) for (k, i), n in sorted(total.items())] + [("pages", True, pages_seen, pages_seen)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    counts = pages.select("html").mapInArrow(run, "kind string, inside boolean, n long, pages long")
    counts = counts.groupBy("kind", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    counts = materialize(counts, "kinds")  # read twice, pages parsed once
    all_pages = counts.where("kind = 'pages'").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    kept = (F.col("pages") * 10000 >= all_pages) | ~F.col("kind").startswith("t:") | F.col("kind").isin(_FIXED)
    common = counts.where("kind <> 'pages'").where(kept).select("kind", "inside", "n")
    return weights_of({(r["kind"], r["inside"]): r["n"] for r in common.collect()})


def extracted(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without a positive region, have an empty text.
    Repeated rows and null ids or urls are returned as they are; other columns are
    ignored. Whole pages are read; nothing is cut.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h or "", weights) for h in batch.column(2).to_pylist()], pa.string())
            columns = [batch.column(0), batch.column(1).cast(pa.string()), texts, pc.utf8_length(texts).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shape = "page_id long, url string, text string, n_chars long"
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, shape)
