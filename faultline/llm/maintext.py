"""Main text of web pages by deducing each host's template.

Pages are cut into tokens: start tags, told apart by the path of elements above them, and blocks of text. Over
all pages of a host, tokens with the same occurrence vector (how often they stand on each page) form an
equivalence class; a digest of the vector is summed up page by page, so no host's pages are ever gathered.
A class is valid if it is large and frequent enough and its tokens stand in one fixed order, over and over, on every
page. Valid classes, largest first, make up the template as far as they nest: an occurrence of one lies in one gap of the
other, the same on every page. Text between the template's tokens fills its slots, text that is itself a template token
does not. A slot is read unless the elements it lies in are menus, headers, footers, side boxes, notices, adverts,
forms or comments; if the template has an article (or main) element on most pages, only slots within it are read, and
text there is read whether pages share it or not (copies and licence lines belong to an article).

Words of class, id or role count if a whole one consists of them. They don't count on html and body, nor on an
element around the article, unless the page has another article without.

Hosts with fewer than `FEW` pages take the template that all hosts share.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated pages get equal
texts; broken markup is read as far as it goes, an unfinished tag at the end is markup; an empty table gives no
rows; other columns are kept by `extract`, but for `text` and `n_chars`, which it sets.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import saved

#: Pages below which a host has no template of its own, and the share of pages a class needs.
FEW, SHARE = 3, 0.6
_HALF = (1 << 32) - 1  # vectors are summed as two halves of a digest
#: Tokens that a valid class has at least.
LARGE = 2
#: Hosts up to which templates are sent to all tasks.
HOSTS = 20_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")

# fixed values of HTML
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_HOLDS = set("article aside blockquote body div footer form header li main nav ol section table td th ul".split())  # a new p in one of these leaves an outer p alone
# end of fixed values

#: Elements, and words of class, id or role, that hold no main text.
ASIDE = set("nav aside footer form head button dialog menu input label".split())
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice newsletter subscribe signup login comment comments commentlist disqus respond reply replies related recommended share sharing social toolbar popup modal overlay search pagination pager skip complementary contentinfo form".split())
MAIN = set("article main".split())


@dataclass
class Block:
    path: str
    skip: bool
    main: bool
    around: bool  # an element around the article is marked
    text: str
    token: str


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def parse(page: str | None) -> tuple[list[str], list[Block]]:
    """Tokens in their order (`<path` for start tags, `=digest` for blocks of text), and the blocks with where they stand."""
    page = page or ""
    stack = [("", "", False, False, False)]  # element, its path, whether it is left out, whether it is main, whether a main element is in a marked one
    order: list[str] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    at_block = ("", False, False, False)

    def close() -> None:
        nonlocal pieces, at_block
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(*at_block, text, f"={_digest(text)}"))
            order.append(blocks[-1].token)
        pieces = []

    def say(text: str) -> None:
        nonlocal at_block
        top = stack[-1]
        here = top[1:]
        if pieces and here[1:] != at_block[1:]:
            close()
        if not pieces:
            at_block = here
        pieces.append(text)

    last = 0
    for m in _TOKEN.finditer(page):
        if m.start() > last:
            say(page[last : m.start()])
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if name in _BLOCK:
                close()
            if depth:
                del stack[depth:]
            continue
        if name == "br":
            say(" ")
            continue
        if name in _BLOCK:
            close()
            for i in range(len(stack) - 1, 0, -1):  # what this tag ends implicitly
                open_ = stack[i][0]
                if name in _CLOSED_BY.get(open_, ()):
                    del stack[i:]
                    break
                if open_ in _HOLDS and open_ != "li" or open_ == "li" and name != "li":
                    break
        marks = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _ATTR.findall(m["attrs"])]
        _, path, skip, main, around = stack[-1]
        label = name + "".join(f".{v}" for k, v in sorted(marks) if k != "id")
        path = f"{path}/{label}"
        order.append(f"<{path}")
        if name in _VOID or m["attrs"].endswith("/"):
            continue
        main_here = name in MAIN or any(k == "role" and v == "main" or k == "itemprop" and v == "articlebody" for k, v in marks)
        marked = name not in ("html", "body") and any(w and set(w) <= MARKS for _, v in marks for w in map(_WORD.findall, v.split()))
        if main_here and not main:
            skip, around = False, skip
        skip_here = name in ASIDE or marked and not main_here or name == "header" and not main
        stack.append((name, path, skip or skip_here, main or main_here, around))
    if last < len(page):
        say(page[last:])
    close()
    return order, blocks


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def tokens(page: str | None) -> dict[str, int]:
    """How often each token stands on the page, and "" once."""
    return Counter(["", *parse(page)[0]])


def places(order: list[str], classes: list[tuple[int, list[str]]]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """On a page: each class's order as a digest, or -1; and for pairs of ordered classes the gap of the second that the first lies in, or -1."""
    of = {t: i for i, (_, tokens) in enumerate(classes) for t in tokens}
    at: dict[int, list[int]] = {}
    for place, t in enumerate(order):
        if (i := of.get(t)) is not None:
            at.setdefault(i, []).append(place)
    orders, gaps, ordered = {}, {}, {}
    for i, found in at.items():
        size = len(classes[i][1])
        names = [order[x] for x in found]
        fixed = len(set(names[:size])) == size and names == names[:size] * (len(names) // size)
        orders[classes[i][0]] = _digest("\n".join(names[:size])) if fixed else -1
        if fixed:
            ordered[i] = np.array(found), size
    for i, (x, size) in ordered.items():
        for j, (y, other) in ordered.items():
            if i != j:
                first, last = np.searchsorted(y, x[::size]), np.searchsorted(y, x[size - 1 :: size])
                gap = first % other
                gaps[classes[i][0], classes[j][0]] = int(gap[0]) if (first == last).all() and (gap == gap[0]).all() else -1
    return orders, gaps


def template_of(table: pa.Table) -> pa.Table:
    """One host's template from its classes (`tokens` set) and pairs (`other` set), largest class first."""
    rows = table.to_pylist()
    inside = {(r["vector"], r["other"]): r["fixed"] for r in rows if r["other"] is not None}
    kept: list[int] = []
    tokens: list[str] = []
    for r in sorted((r for r in rows if r["other"] is None and r["fixed"]), key=lambda r: (-len(r["tokens"]), -r["n"], r["vector"])):
        v = r["vector"]
        if all(inside.get((v, k), True) or inside.get((k, v), True) for k in kept):
            kept.append(v)
            tokens += r["tokens"]
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "pages": pa.array([rows[0]["pages"]], pa.int64()), "tokens": pa.array([tokens], pa.list_(pa.string()))})


def templates(pages: DataFrame) -> DataFrame:
    """host, pages, tokens: the template of every host (tokens of its valid classes); host null: the one all hosts share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = {}
            for h, key, page in zip(*(batch.column(c) for c in ("_host", "_key", "html"))):
                seed = key.as_py() & 0xFFFFFFFFFFFF
                for t, n in tokens(page.as_py()).items():
                    x = found.setdefault((h.as_py(), t), [0, 0, 0])
                    digest = xxhash.xxh64_intdigest(b"%d:%d" % (seed, n))
                    x[0] += 1
                    x[1] += digest & _HALF
                    x[2] += digest >> 32 & _HALF
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 *(pa.array([x[i] for x in found.values()], pa.int64()) for i in range(3))],
                ["host", "token", "n", "low", "high"])

    rows = pages.select(host(F.col("url")).alias("_host"), F.xxhash64("url", "html").alias("_key"), F.col("html").cast("string").alias("html"))
    # sums, so that a page that stands twice counts twice instead of cancelling itself
    sums = [F.sum(c).alias(c) for c in ("n", "low", "high")]
    counted = saved(rows.mapInArrow(run, "host string, token string, n long, low long, high long").groupBy("host", "token").agg(*sums))
    # text is no token of the template that all hosts share
    shared = counted.where("token = '' or token like '<%'").groupBy("token").agg(*sums).select(F.lit(None).cast("string").alias("host"), "token", "n", "low", "high")
    counted = counted.unionByName(shared).select("host", "token", "n", F.xxhash64("low", "high").alias("vector"))
    sizes = counted.where("token = ''").select(F.col("host").alias("_h"), F.col("n").alias("pages"))
    near = counted.where("token <> ''").join(sizes, F.col("host").eqNullSafe(F.col("_h"))).where((F.col("pages") >= FEW) & (F.col("n") >= SHARE * F.col("pages")))
    classes = near.groupBy("host", "vector").agg(F.first("pages").alias("pages"), F.max("n").alias("n"), F.collect_list("token").alias("tokens"))
    # at most mean tokens per page / SHARE tokens for each host; a main element may be alone
    alone = F.regexp_extract(F.col("tokens")[0], r"^<.*/([^/.]*)[^/]*$", 1).isin(*MAIN)
    classes = saved(classes.where((F.size("tokens") >= LARGE) | alone))
    common = [(r["vector"], r["tokens"]) for r in classes.where("host is null").collect()]
    own = classes.where("host is not null").groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("vector", "tokens")).alias("_classes"))
    own = F.broadcast(own) if own.limit(HOSTS + 1).count() <= HOSTS else own

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for h, page, given in zip(*(batch.column(c) for c in ("_host", "html", "_classes"))):
                order = parse(page.as_py())[0]
                for name, sets in ((h.as_py(), [(c["vector"], c["tokens"]) for c in given.as_py() or []]), (None, common)):
                    orders, gaps = places(order, sets)
                    for key, x in [*(((name, v, None), x) for v, x in orders.items()), *(((name, *k), x) for k, x in gaps.items())]:
                        y = found.setdefault(key, [x, x])
                        y[0], y[1] = min(y[0], x), max(y[1], x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))), *(pa.array([x[i] for x in found.values()], pa.int64()) for i in (0, 1))],
                ["host", "vector", "other", "low", "high"])

    placed = rows.join(own, "_host", "left").select("_host", "html", "_classes").mapInArrow(place, "host string, vector long, other long, low long, high long")
    placed = placed.groupBy("host", "vector", "other").agg((F.min("low") == F.max("high")).alias("same"), F.min("low").alias("low"))
    placed = placed.select("host", "vector", "other", (F.col("same") & (F.col("low") >= 0)).alias("fixed"))
    facts = classes.select(F.col("host").alias("_h"), F.col("vector").alias("_v"), "pages", "n", "tokens")
    facts = placed.join(facts, F.col("host").eqNullSafe(F.col("_h")) & (F.col("vector") == F.col("_v"))).select(
        "host", "vector", "other", "fixed", "pages", "n", F.when(F.col("other").isNull(), F.col("tokens")).alias("tokens"))
    return saved(facts.groupBy("host").applyInArrow(template_of, "host string, pages long, tokens array<string>"))


def read_slots(page: str | None, template: frozenset[str]) -> list[str]:
    """The blocks of a page in its template's slots."""
    _, blocks = parse(page)
    inner = any(step.split(".")[0] in MAIN for t in template if t[0] == "<" for step in t.rsplit("/", 1)[-1:])
    kept = [b for b in blocks if not b.skip and not b.around]
    if not any(b.main for b in kept):  # all articles stand in marked elements
        kept = [b for b in blocks if not b.skip]
    if (inner or not template) and any(b.main for b in kept):
        return [b.text for b in kept if b.main]
    return [b.text for b in kept if b.main or b.token not in template]


def extract(pages: DataFrame) -> DataFrame:
    """All columns of `pages` with `text` (the main text) and `n_chars`."""
    made = templates(pages)
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host(F.col("url")).alias("_host"))
    common = made.where("host is null").select("tokens").head(1)
    common = common[0][0] if common else []
    made = made.where("host is not null").select(F.col("host").alias("_host"), F.col("tokens").alias("_tokens"))
    made = F.broadcast(made) if made.limit(HOSTS + 1).count() <= HOSTS else made
    rows = rows.join(made, "_host", "left").drop("_host")
    shared = pages.sparkSession.sparkContext.broadcast(frozenset(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, frozenset[str]] = {}
        for batch in batches:
            texts = []
            for page, given in zip(batch.column("html"), batch.column("_tokens")):
                if given.is_valid:
                    listed = given.as_py()
                    template = sets.get(key := hash(tuple(listed)))
                    if template is None:
                        template = sets[key] = frozenset(listed)
                else:
                    template = shared.value
                texts.append("\n\n".join(read_slots(page.as_py(), template)))
            if len(sets) > 200:
                sets.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], [*kept, "text", "n_chars"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in kept]).schema.fields)
    return rows.mapInArrow(run, kind + ", text string, n_chars long")
