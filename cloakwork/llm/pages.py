"""Main text of web pages: markup gives blocks, a suffix array of each host finds what its pages repeat.

A page's markup becomes blocks of text.  Some markup says for certain what a block is: scripts, styles, menus, footers, forms,
adverts, notices and reader comments are no text; what stands in the article element is.  For the rest - blocks outside the
article, and those inside whose class names leave a doubt - the host decides: the token streams of its pages are concatenated; a
suffix array (prefix doubling to full order, with common lengths) brings equal substrings together; those of at least RUN tokens that
occur on two pages with different streams are boilerplate, and a block that they cover for COVERED or more of its tokens
goes.  Blocks with unique runs stay.  Undoubted paragraphs of articles stay whatever other pages repeat: copies and
quotations are text.

Pages meet by host in groups of about GROUP_BYTES: small hosts share a group, a host with more is dealt over several.  What
such a host repeats is counted over all its groups: 64-bit hashes of runs meet with those of their streams, and each
group gets the repeated runs that it holds.  So a host with a third of all pages is spread over many tasks, and results
do not depend on how hosts are dealt.

Defined cases: null html is empty text; null url is a host of its own name (empty); repeated rows give the same text, as
equal streams count once; markup that is cut off ends where it ends; if all blocks of a page would go, those that no markup
excludes stay; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, small, small_or, staged, table
from .exchange import run_hashes
from .urls import split_url

RUN = 4
COVERED = 0.8
GROUP_BYTES = 4_000_000

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|svg|canvas|object|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[a-zA-Z/!?](?:"[^"]*"|'[^']*'|[^'">])*>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<""", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_MARK = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s>=/])|display\s*:\s*none""", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
_OUT = frozenset("head nav footer aside form menu dialog".split())
_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments replies discussion disqus widget toolbar pagination pager search skip contentinfo complementary".split())
#: Parts that a class name may have beside one of these words and still mean the same.
_HELPERS = frozenset("area bar block bottom box column container content form group header inner item items left link links list main menu message nav outer panel primary right secondary section site slot text thread top unit widget wrap wrapper".split())
_MAIN_WORDS = frozenset(["main", "articlebody"])
#: Elements whose marks say something of the page, not of a part of it.
_WHOLE = frozenset(["html", "body", "article", "main"])


def marked(piece: str) -> str:
    """What the class, id, role and itemprop of a tag say: main, out, doubt or nothing.

    A name says out if it is one of the known words, or made of them and of parts that add nothing (`comment-list`); with any
    other part (`related-work`, `no-sidebar`) it is a doubt, which the host's repeats settle.
    """
    found = ""
    for _, *v in _MARK.findall(piece):
        for name in "".join(v).lower().split():
            parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
            if name in _MAIN_WORDS:
                return "main"
            if any(x in _OUT_WORDS for x in parts):
                if all(x in _OUT_WORDS or x in _HELPERS or x.isdigit() for x in parts):
                    return "out"
                found = "doubt"
    return found


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; zone: main, out, open or doubt."""
    found: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # (element, zone inside)
    zone = "open"

    def close() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            found.append((zone, text))

    for m in _PIECE.finditer(page):
        piece = m.group()
        if piece[0] != "<" or len(piece) == 1:
            held.append(entities.unescape(piece) if "&" in piece else piece)
            continue
        name = _NAME.match(piece)
        if m.group(1) or not name:
            continue
        if not piece.endswith(">"):
            break  # cut off within a tag
        tag = name.group(1).lower()
        if tag == "br":
            held.append(" ")
        if piece[1] == "/":
            if tag in _BLOCK:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    zone = stack[-1][1] if stack else "open"
                    break
            continue
        if tag in _BLOCK:
            close()
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        zone = stack[-1][1] if stack else "open"
                        break
                    if stack[k][0] in _BLOCK:
                        break
        if tag in _VOID or piece.endswith("/>"):
            continue
        inner = zone
        if zone != "out":
            says = marked(piece) if "=" in piece and tag not in _WHOLE else ""
            if tag in _OUT or tag == "header" and zone == "open" or says == "out" or tag not in _WHOLE and _HIDDEN.search(piece):
                inner = "out"
            elif tag in ("article", "main") or says == "main":
                inner = "main"
            elif says == "doubt":
                inner = says
        if inner != zone and tag not in _BLOCK:
            close()
        stack.append((tag, inner))
        zone = inner
    close()
    return found


def suffixes(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of all streams together, length of what each suffix shares with the one before it); suffixes end with their stream.

    Prefix doubling: ranks by the first 1, 2, 4 … tokens, until no two suffixes that go on are alike; going back over the
    ranks gives the common lengths.
    """
    sizes = np.array([len(s) for s in streams])
    n = int(sizes.sum())
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64) + 1
    ranks = [rank]
    while (1 << len(ranks)) <= 2 * int(sizes.max(initial=1)) and int(ranks[-1].max(initial=0)) < n:
        step = 1 << (len(ranks) - 1)
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - step)] = ranks[-1][step:]
        after[at + step >= ends] = 0
        ranks.append(np.unique(ranks[-1] * (n + 2) + after, return_inverse=True)[1] + 1)
    array = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, dtype=np.int64)
    i, j = array[1:].copy(), array[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        fits = np.flatnonzero((i + step <= ends[array[1:]]) & (j + step <= ends[array[:-1]]))
        fits = fits[ranks[level][i[fits]] == ranks[level][j[fits]]]
        shared[1:][fits] += step
        i[fits] += step
        j[fits] += step
    return array, shared


def repeated(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run of at least `run` tokens that another stream has too.

    In the suffix array, suffixes that share `run` tokens or more stand together; each in a stretch of two streams or
    more covers its first `run` tokens, and the suffixes that follow it in its stream cover what a longer repeat has more.
    """
    sizes = np.array([len(s) for s in streams])
    n = int(sizes.sum())
    covered = np.zeros(n, dtype=bool)
    if n:
        array, shared = suffixes(streams)
        owner = np.repeat(np.arange(len(streams)), sizes)[array]
        stretch = np.cumsum(shared < run) - 1
        first = np.flatnonzero(shared < run)
        differ = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        starts = array[differ[stretch]]
        change = np.zeros(n + 1, dtype=np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + run, -1)
        covered = np.cumsum(change)[:-1] > 0
    return np.split(covered, np.cumsum(sizes)[:-1])


def open_words(page: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(block, word) of a page's stream: what stands outside its articles."""
    return [(b, w) for b, (zone, text) in enumerate(page) if zone != "main" for w in text.split()]


def stream_runs(held: WordHash, words: list[str], run: int) -> np.ndarray:
    """The hash of each run of `run` words."""
    hashes = held.of([w.encode("utf-8", "surrogatepass") for w in words])
    at = np.arange(max(0, len(hashes) - run + 1))
    return run_hashes(hashes, at, at + run) if len(at) else np.zeros(0, np.uint64)


def covered_by(held: WordHash, words: list[str], run: int, known: np.ndarray) -> np.ndarray:
    """Which words lie in a run whose hash is known (sorted)."""
    hashes = stream_runs(held, words, run)
    starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + run, -1)
    return np.cumsum(change)[:-1] > 0


def main_texts(pages: list[str], run: int = RUN, share: float = COVERED, known: np.ndarray | None = None) -> list[str]:
    """The main text of each page; all are pages of one host.  known: sorted hashes of the runs that the host repeats, where these are not all its pages."""
    parsed = [blocks(p) for p in pages]
    number: dict[str, int] = {}
    streams, where, of = [], [], {}
    for k, page in enumerate(parsed):
        words = open_words(page)
        key = tuple(w for _, w in words)
        if key not in of:
            of[key] = len(streams)
            streams.append(np.array([number.setdefault(w, len(number)) for w in key], dtype=np.int64))
        where.append((of[key], np.array([b for b, _ in words], dtype=np.int64)))
    if known is not None:
        held = WordHash()
        covered = [covered_by(held, list(key), run, known) for key in of]
    else:
        covered = repeated(streams, run) if streams else []
    out = []
    for page, (stream, owner) in zip(parsed, where):
        n = np.bincount(owner, minlength=len(page)) if len(owner) else np.zeros(len(page), int)
        c = np.bincount(owner, weights=covered[stream], minlength=len(page)) if len(owner) else n
        may = [b for b, (zone, _) in enumerate(page) if zone != "out"]
        stay = [b for b in may if page[b][0] == "main" or c[b] < share * n[b]]  # doubts and open blocks by what repeats
        out.append("\n\n".join(page[b][1] for b in stay or may))
    return out


_SCHEMA = "page_id long, url string, text string, n_chars long"


_RUNS = "_group long, run long, _part long, least long, most long"


def _host_runs(run: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each run of a batch's pages by host and part, with the least and greatest hash of the streams it is in."""
        held = WordHash()
        for batch in small(batches):
            found = defaultdict(list)
            for group, part, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = [w for _, w in open_words(blocks(page or ""))]
                hashes = np.unique(stream_runs(held, words, run))
                if len(hashes):
                    stream = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), 11)
                    found[group, part].append((hashes, np.full(len(hashes), stream, np.uint64)))
            for (group, part), each in found.items():
                hashes, streams = (np.concatenate(x).view(np.int64) for x in zip(*each))
                order = np.lexsort((streams, hashes))
                hashes, streams = hashes[order], streams[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                last = np.concatenate([first[1:], [len(hashes)]]) - 1
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int64)), pa.array(hashes[first]), pa.array(np.full(n, part, np.int64)), pa.array(streams[first]), pa.array(streams[last])], names=["_group", "run", "_part", "least", "most"])

    return runs


def _extract(run: int, share: float):
    def extract(group: pa.Table, repeats: pa.Table | None) -> pa.Table:
        hosts = defaultdict(list)
        for k, host in enumerate(group["_host"].to_pylist()):
            hosts[host].append(k)
        raw = group["_html"].to_pylist()
        texts = [""] * len(raw)
        known = None
        if repeats is not None and len(raw) and group["_part"][0].as_py() > 0:
            known = np.unique(repeats["run"].to_numpy().astype(np.int64).view(np.uint64))
        for rows in hosts.values():
            for k, text in zip(rows, main_texts([raw[k] or "" for k in rows], run, share, known)):
                texts[k] = text
        return pa.table([group["_id"].cast(pa.int64()), group["_url"].cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, share: float = COVERED, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    df = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    df = df.withColumn("_host", split_url(F.col("_url"))[0])
    by_host = staged(df.groupBy("_host").agg(F.sum(F.coalesce(F.octet_length("_html"), F.lit(0))).alias("_bytes")), "hosts")
    groups = max(8, -(-(by_host.agg(F.sum("_bytes")).first()[0] or 0) // group_bytes))
    large = by_host.where(F.col("_bytes") > group_bytes).select("_host", F.ceil(F.col("_bytes") / group_bytes).alias("_parts"))
    split = not large.isEmpty()
    df = df.join(small_or(large, 100_000), "_host", "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_id", "_url"), F.col("_parts")) + 1).otherwise(F.lit(0))
    name = F.when(F.col("_parts").isNotNull(), F.xxhash64("_host")).otherwise(F.pmod(F.xxhash64("_host"), F.lit(groups)))
    dealt = df.select(name.alias("_group"), part.cast("long").alias("_part"), "_id", "_url", "_host", "_html")
    # as many partitions as groups, so that a task's share does not grow with the input
    by_group = dealt.repartition(groups, "_group", "_part").groupBy("_group", "_part")
    extract = _extract(run, share)
    if not split:
        return by_group.applyInArrow(lambda group: extract(group, None), _SCHEMA)
    runs = dealt.where("_part > 0").select("_group", "_part", "_html").mapInArrow(_host_runs(run), _RUNS)
    twice = runs.groupBy("_group", "run").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_set("_part").alias("parts")).where("least <> most")
    repeats = staged(twice.select("_group", F.explode("parts").alias("_part"), "run"), "repeats").repartition(groups, "_group", "_part")
    return by_group.cogroup(repeats.groupBy("_group", "_part")).applyInArrow(lambda group, own: extract(group, own), _SCHEMA)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
