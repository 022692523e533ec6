"""Main text of web pages by markup and by differencing with the nearest page of the host.

A page becomes a sequence of lines, one per block. Elements that are never article text
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) are
known by tag, role, class or id. Pages are sorted by host and path; each is paired with the
neighbour of its host that shares most leading path parts, its lines are aligned with the
neighbour's by a longest common subsequence, and shared lines are deleted. Inside a marked article
only lines of the neighbour's text count, and one neighbour is not enough: a line goes if at
least three articles of the host and more than half of them hold it too, where articles that agree in
their other lines count once. A pair are copies if the shared
lines hold most of both articles or nine tenths of both unmarked pages, in lines and in
characters, or if one is the other's beginning. A page is then aligned with the next nearest
page of its host, until one is no copy; it loses nothing if there is none, or if the page
itself is the beginning that was cut off.

Null and empty html, null urls (host and path empty) and pages without a neighbour are
handled like others; a page without text gives the empty text. Pages that were cut off in
the middle end there. Repeated rows are pages of their own. Other columns pass through;
one called ``out`` is replaced.
"""

import bisect
import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvecal.llm.common import shuffle_files_freed, unused_names
from curvecal.llm.url_reputation import url_host, url_path
from curvecal.session import materialize

# Fixed names of HTML elements and usual names of page parts.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav footer aside form head menu dialog button select iframe object svg canvas audio video map template noscript".split())
RAW = "script|style|textarea|xmp|noframes"
PARTS = re.compile(r"""(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert
    |sidebar|comments?|replies|reply|respond|disqus|menu|nav|navbar|navigation|breadcrumbs?|share|sharing|social|related|recommend\w*
    |newsletter|subscri\w*|footer|header|masthead|popup|modal|widget|pagination)(?:$|[\s_-])""", re.X)
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z) | <(?P<raw>{RAW})\b.*?(?:</(?P=raw)\s*>|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.X | re.S | re.I)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
ARTICLE, OPEN, OUTSIDE = 2, 1, 0


def _role(tag: str, attributes: str, in_article: bool) -> int | None:
    """What an element opens: the article, a part that is never article text, or nothing special."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    if tag in NEVER or tag == "header" and not in_article:
        return OUTSIDE
    if tag not in ("html", "body", "main") and (
            any(PARTS.search(found.get(k, "")) for k in ("class", "id")) or found.get("role", "").lower() in ROLES
            or "hidden" in found or found.get("aria-hidden", "").lower() == "true"):
        return OUTSIDE
    if tag in ("article", "main") or found.get("itemprop", "") == "articleBody" or found.get("role", "").lower() in ("main", "article"):
        return ARTICLE
    return None


def page_lines(source: str | None) -> list[tuple[str, int]]:
    """Lines of a page with their zone."""
    lines: list[tuple[str, int]] = []
    if not source:
        return lines
    stack: list[tuple[str, int]] = [("", OPEN)]
    text: list[str] = []

    def flush():
        line = SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if line:
            lines.append((line, stack[-1][1]))

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            text.append(entities.unescape(source[at:m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        if m["end"]:
            if any(t == tag for t, _ in stack):
                if tag not in BLOCKS and any(t in BLOCKS for t, _ in stack[max(i for i, (t, _) in enumerate(stack) if t == tag) + 1:]):
                    continue  # an inline end tag closes no block
                while stack[-1][0] != tag:
                    stack.pop()
                if stack[-1][1] != stack[-2][1]:
                    flush()
                stack.pop()
            continue
        if tag in VOID or m["attributes"].rstrip().endswith("/"):
            continue
        if tag == "p" or tag in ("li", "tr", "td", "th", "dt", "dd", "option"):  # these end one another
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS and stack[i][0] != "p":
                    break
        zone = stack[-1][1]
        role = _role(tag, m["attributes"], zone == ARTICLE)
        if zone != OUTSIDE and role is not None and role != zone:
            flush()
            zone = role
        stack.append((tag, zone))
    if at < len(source):
        rest = source[at:]
        text.append(entities.unescape(rest[:-len(cut[0])] if (cut := re.search(r"<[^<]*\Z", rest)) else rest))
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence (matches of later b first, then longest rise)."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, object]] = []
    for i, h in enumerate(a):
        for j in where.get(h, ()):
            k = bisect.bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _text_of(zones: list[int]) -> list[int]:
    """Places of the lines that main_text keeps."""
    wanted = ARTICLE if ARTICLE in zones else OPEN
    return [i for i, z in enumerate(zones) if z == wanted]


def _most(shared: list[int], text: list[int], sizes: list[int], marked: bool) -> bool:
    part, whole = sum(sizes[i] for i in shared), sum(sizes[i] for i in text)
    return 2 * part > whole if marked else bool(shared) and 10 * part >= 9 * whole and 10 * len(shared) >= 9 * len(text)


def shared_places(zones: list[int], sizes: list[int], hashes: list[int], other_zones: list[int], other_sizes: list[int],
                  other: list[int]) -> list[int] | None:
    """Which lines of the page's text to delete (places in its text): the shared ones; None if another page is to be tried."""
    text, other_text, marked = _text_of(zones), _text_of(other_zones), ARTICLE in zones
    if marked:  # lists of other articles beside the neighbour's text say nothing about this one
        near = [h for z, h in zip(other_zones, other) if z != OUTSIDE]
        gone = {text[k] for k in common_lines([hashes[i] for i in text], near)}
    else:
        gone = set(common_lines(hashes, other))
    shared = [k for k, i in enumerate(text) if i in gone]
    known = {hashes[text[k]] for k in shared}
    own = _most([text[k] for k in shared], text, sizes, marked)
    its = _most([i for i in other_text if other[i] in known], other_text, other_sizes, ARTICLE in other_zones)
    if own and its:
        return None
    n = len(shared)
    if (own or its) and [hashes[i] for i in text[:n]] == [other[i] for i in other_text[:n]] and n >= min(len(text), len(other_text)) - 1:
        return None if its else []
    return shared


def main_text(lines: list[tuple[str, int]]) -> str:
    wanted = ARTICLE if any(z == ARTICLE for _, z in lines) else OPEN
    return "\n".join(x for x, z in lines if z == wanted)


def line_hash(line: str) -> int:
    raw = line.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def deletions(pages: DataFrame) -> DataFrame:
    """(key, deleted) of the pages that lose lines. pages: key, host, path, html.

    Texts stay where they are: pages meet as hashes and sizes of their lines.
    """
    kind = "key bigint, host string, path string, zones array<int>, sizes array<int>, hashes array<bigint>"

    def parse(batches):
        for b in batches:
            rows = [page_lines(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("key"), b.column("host"), b.column("path"),
                pa.array([[z for _, z in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[len(x) for x, _ in r] for r in rows], pa.list_(pa.int32())),
                pa.array([[line_hash(x) for x, _ in r] for r in rows], pa.list_(pa.int64()))],
                names=["key", "host", "path", "zones", "sizes", "hashes"])

    with shuffle_files_freed(pages.sparkSession):
        slim = materialize(pages.mapInArrow(parse, kind), "page-lines")
        ordered = materialize(slim.dropDuplicates(["key"]).repartitionByRange("host", "path", "key")
                              .sortWithinPartitions("host", "path", "key").withColumn("place", F.monotonically_increasing_id()), "pages")
    # places without gaps: the rows of earlier partitions are added (one number per partition)
    task, before, starts = F.shiftright("place", 33), 0, []
    for number, n in sorted((r[0], r[1]) for r in ordered.groupBy(task).count().collect()):
        starts.append((number, before))
        before += n
    offsets = ordered.sparkSession.createDataFrame(starts or [(0, 0)], "task bigint, before bigint")
    placed = (ordered.withColumn("task", task).join(offsets, "task")
              .withColumn("n", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("task", "before", "place"))
    slim = placed.select("n", "host", F.split("path", "/").alias("parts"))
    lines = placed.select("n", "key", "zones", "sizes", "hashes")
    others = placed.select(F.col("n").alias("near"), F.col("zones").alias("other_zones"), F.col("sizes").alias("other_sizes"), F.col("hashes").alias("other"))

    def beside(name):
        return slim.select(F.col("n").alias(name), F.col("host").alias(f"{name}_host"), F.col("parts").alias(f"{name}_parts"))

    def alike(name):
        return F.expr(f"""CASE WHEN {name}_host = host THEN size(filter(sequence(1, least(size(parts), size({name}_parts))),
            i -> slice(parts, 1, i) = slice({name}_parts, 1, i))) ELSE -1 END""")

    def align(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("zones", "sizes", "hashes", "other_zones", "other_sizes", "other")]
            gone = [shared_places(*row) for row in zip(*columns)]
            marked = [ARTICLE in zones for zones in columns[0]]
            lost = [[[h for z, h in zip(zones, hashes) if z == (ARTICLE if m else OPEN)][i] for i in places or ()]
                    for zones, hashes, m, places in zip(columns[0], columns[2], marked, gone)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("n", "key", "p", "q", "near")), pa.array(gone, pa.list_(pa.int32())),
                                              pa.array(marked), pa.array(lost, pa.list_(pa.int64()))],
                                             names=["n", "key", "p", "q", "near", "deleted", "marked", "lost"])

    def aligned(sides):
        """(n, key, p, q, near, deleted) of pages with the places p and q of the nearest pages before and behind that are left to try."""
        near = sides.join(slim, "n").join(beside("p"), "p", "left").join(beside("q"), "q", "left").select(
            "n", "p", "q", F.coalesce(alike("p"), F.lit(-1)).alias("a"), F.coalesce(alike("q"), F.lit(-1)).alias("b")).where("a >= 0 OR b >= 0").select(
            "n", "p", "q", F.when(F.col("a") >= F.col("b"), F.col("p")).otherwise(F.col("q")).alias("near"))
        return near.join(lines, "n").join(others, "near").select(
            "n", "key", "p", "q", "near", "zones", "sizes", "hashes", "other_zones", "other_sizes", "other").mapInArrow(
            align, "n bigint, key bigint, p bigint, q bigint, near bigint, deleted array<int>, marked boolean, lost array<bigint>")

    def next_sides(copies, known):
        """Past a copy: where the copy itself has got to on that side, so that a row of copies is crossed in a few rounds."""
        past = known.select(F.col("n").alias("near"), F.col("p").alias("near_p"), F.col("q").alias("near_q"))
        return copies.join(past, "near", "left").select(
            "n", F.when(F.col("near") == F.col("p"), F.coalesce("near_p", F.col("p") - 1)).otherwise(F.col("p")).alias("p"),
            F.when(F.col("near") == F.col("q"), F.coalesce("near_q", F.col("q") + 1)).otherwise(F.col("q")).alias("q"))

    with shuffle_files_freed(pages.sparkSession):
        known = materialize(aligned(slim.select("n", (F.col("n") - 1).alias("p"), (F.col("n") + 1).alias("q"))), "page-pairs")
        found = known.where(F.size("deleted") > 0).select("n", "key", "deleted", "marked", "lost")
        known = known.where("deleted IS NULL")
        while not (copies := known.where("deleted IS NULL")).isEmpty():
            sides = materialize(next_sides(copies, known), "page-sides")
            tried = materialize(aligned(sides), "page-pairs")
            found = found.unionByName(tried.where(F.size("deleted") > 0).select("n", "key", "deleted", "marked", "lost"))
            ended = sides.join(tried.select("n"), "n", "left_anti").withColumn("deleted", F.expr("CAST(array() AS array<int>)"))
            known = materialize(known.where("deleted IS NOT NULL").unionByName(tried).unionByName(ended, allowMissingColumns=True), "page-known")
    # written, so that weighing these lines does not plan all rounds again
    found = materialize(found.join(slim.select("n", "host"), "n"), "page-found")
    articles = placed.where(F.array_contains("zones", ARTICLE)).select("n", "host", F.expr(
        f"array_distinct(transform(filter(arrays_zip(zones, hashes), x -> x.zones = {ARTICLE}), x -> x.hashes))").alias("lines"))
    return found.where("NOT marked").select("key", "deleted").unionByName(proven(found.where("marked"), articles))


def proven(found: DataFrame, articles: DataFrame) -> DataFrame:
    """(key, deleted) left of what marked pages share with a neighbour: lines that the host's articles repeat.

    ``found``: key, host, deleted, lost (line hashes); ``articles``: n, host, lines (different hashes).
    """
    asked = found.select("host", F.explode("lost").alias("line")).distinct()
    lines = articles.join(asked.select("host").distinct(), "host", "left_semi").select("n", "host", F.explode("lines").alias("line"))
    # an article is known by the smallest hash among its lines that nobody asks for, so copies count once
    each = materialize(lines.join(asked.withColumn("asked", F.lit(True)), ["host", "line"], "left").groupBy("host", "n").agg(
        F.min(F.when(F.col("asked").isNull(), F.col("line"))).alias("own"),
        F.collect_set(F.when(F.col("asked"), F.col("line"))).alias("shared")), "page-articles")
    hosts = each.groupBy("host").agg(F.countDistinct("own").alias("articles"))
    held = each.select("host", "own", F.explode("shared").alias("line")).groupBy("host", "line").agg(F.countDistinct("own").alias("holding"))
    sure = held.join(hosts, "host").where("holding >= 3 AND 2 * holding > articles").select("host", "line")
    places = found.select("key", "host", F.explode(F.arrays_zip("deleted", "lost")).alias("x")).select(
        "key", "host", F.col("x.deleted").alias("place"), F.col("x.lost").alias("line"))
    return places.join(sure, ["host", "line"], "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("deleted"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """Replace the html by the main text.

    Pages are told apart by a hash of url and html (null unlike any text); equal pages have equal
    results. Texts, not pages, meet their deletions.
    """
    kept = [c for c in pages.columns if c not in (html, out)]
    k, t, h, d = unused_names(pages.columns, 4)
    source, address = F.col(f"`{html}`").cast("string"), F.col(f"`{url}`").cast("string")
    key = F.xxhash64(address.isNull(), address, source.isNull(), source)
    gone = materialize(deletions(pages.select(key.alias("key"), url_host(address).alias("host"), url_path(address).alias("path"),
                                              source.alias("html"))), "page-deletions")
    kind = T.StructType([*(pages.schema[c] for c in kept), T.StructField(k, T.LongType()), T.StructField(t, T.StringType())])

    def parse(batches):
        for b in batches:
            texts = [main_text(page_lines(x)) for x in b.column(h).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*kept, k]), pa.array(texts, pa.string())], names=kind.names)

    texts = (pages.select(*(F.col(f"`{c}`") for c in kept), key.alias(k), source.alias(h)).mapInArrow(parse, kind)
             .join(gone.select(F.col("key").alias(k), F.col("deleted").alias(d)), k, "left"))
    cut = F.array_join(F.filter(F.split(F.col(t), "\n"), lambda x, i: ~F.array_contains(F.col(d), i)), "\n")
    return texts.select(*(F.col(f"`{c}`") for c in kept), F.when(F.col(d).isNull(), F.col(t)).otherwise(cut).alias(out))
