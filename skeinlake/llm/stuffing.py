"""Problem 1: keyword-stuffed and link-list pages.

Method: phrase shingles of five words of each page's own content, shown or hidden (``alt`` and ``title``
texts too), are all taken, and distinct hosts are counted per phrase over all pages. Running text is
made of phrases that many hosts say; keywords, names and tags strung together make phrases that no
other host says, or the same phrase over and over. The share of a page's phrases carried by ``MIN_HOSTS`` hosts and the share repeated on the page itself are
joined with its list density: the words in segments that are no sentences (few function words, mostly
links, or one pattern varied), to which the anchors of the page's summary add where one is given.

A page is flagged if

* its list density is ``DENSE`` and its phrases are not carried by other hosts (below ``CARRIED``) or
  are mostly its own repeated (from ``REPEATED`` on), or
* hardly any phrase is carried (below ``ALONE``) and half of its words are in list-like segments by a
  looser pattern, or its summary has as many words in anchors as the page has in all.

The plain reading, a high share of phrases replicated elsewhere as a sign of spam, cannot give the
result: ordinary pages share more phrases with other hosts than stuffed ones do (README, with figures).

Defined results: null or empty pages, pages without own content and pages that are residue of
problem 3 are no cases; code counts as prose; one trailing run of tags behind more prose does not count;
null hosts count as one host; repeated rows of one fetch or summary count once; null links and anchors
count for nothing; extra columns are never read.
"""
from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from skeinlake.llm.common import map_arrow, written
from skeinlake.llm.hashing import _MIX, word_runs
from skeinlake.llm.pages import Page, read_page, visible

SHINGLE = 5
#: Window of ``winnowed``; the phrases of pages are not winnowed.
WINNOW = 4
MIN_HOSTS, MIN_REPEATS = 3, 3
#: Share of list-like words from which a page is dense, and from which many anchors can decide.
DENSE, MIXED = 0.5, 0.3
#: Share of phrases that other hosts have below which a dense page is flagged, and below which loose evidence is enough.
CARRIED, ALONE = 0.5, 0.1
#: Share of phrases repeated on the page itself from which a dense page is flagged whatever other hosts have.
REPEATED = 0.3
#: Words in anchors of the summary for each word of the page.
LINKED = 1.0
#: Below this share of function words a segment is no sentence; above the second, surely one.
FUNCTION_SHARE, WEAK_SHARE = 0.21, 0.45
#: From so many words on, the share of distinct word pairs tells lists from sentences.
LONG = 40
#: From so many segments that share this part of their word pairs, segments are one pattern repeated; the second is loose.
MIN_PATTERN, PATTERN, LOOSE_PATTERN = 4, 0.5, 0.25

# fixed values: frequent function words of nine languages
FUNCTION_WORDS = frozenset(
    """the of and to in a is that it for on as with was by not be this are or from at which but have an they you were there been one all we can has more if no when
    what so about into only do also than them some would other while before after until because whose who whether does did so how why where i he she his her their our its
    der die das und ist nicht den von zu mit dem ein eine auf für es sich des im als auch werden aus er hat dass sie nach wird bei noch wie einem über zum kein keine war nur
    oder aber vor zur bis mehr durch man dann etwa wenn gibt wieder ohne weil damit sobald obwohl einen einer ihr wir uns
    le la les de et est un une que dans du pour pas qui sur plus par ce avec au il ne se son sa mais nous ou cette l d c qu n s sont même sans été cela dès deux fois parce avant fait notre
    el los las y en por con para una su al lo como más pero sus le ya o fue este ha sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde nos nuestra nada nadie
    o os as e do da em um uma com não se na no por mais dos como mas foi ao ele das tem seu sua ou ser quando muito há nos já está eu também pelo pela até isso
    il lo gli di che e non è per una con si da del della nel alla al ma come più sono ha dei le anche se nostra nostro questa prima quando
    de het een van en is dat op te in met voor niet zijn er aan om ook als dan maar bij nog uit naar door over ze hij wordt zodra
    и в не на что с по это как из у за от так же но к для до бы если чтобы уже или мы его наш нашу пока""".split()
)
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")


def winnowed(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Distinct fingerprints of a text by winnowing: the least hash of every ``window`` phrases in a row.

    Two texts that share ``window + SHINGLE - 1`` words in a row share a fingerprint, wherever those words stand.
    """
    if len(hashes) > window:
        hashes = sliding_window_view(hashes, window).min(axis=1)
    return np.unique(hashes)


class _Hashes(dict):
    """Hashes of words by word, the lowest bit tells function words; emptied once it holds a million."""

    def __missing__(self, w):
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) & -2 | (w in FUNCTION_WORDS)
        return h


_hashes = _Hashes()
#: Of ASCII text in lower case, the letters and one sign for all digits.
_LETTERS = {i: chr(i) if chr(i).isalpha() else "\0" if chr(i).isdigit() else " " for i in range(128)}


def _words(text: str) -> list[str]:
    """Runs of letters and runs of digits of a text in lower case."""
    text = text.lower()
    if text.isascii():
        letters = text.translate(_LETTERS)
        if "\0" not in letters:
            return letters.split()
    return _WORD.findall(text)


def evidence(page: Page) -> tuple[int, int, int, np.ndarray, list[int]]:
    """Words of the own content, list-like and loosely list-like words among them, the hash of each word, and the words of each text."""
    total = listed = loose = prose = 0
    runs = []  # list-like segments as [words, hidden, tag]
    weak = []  # sentences with few function words: list-like if they only vary one pattern
    texts, flat = [], []
    for s in page.segments:
        if s.junk:
            continue
        if s.code:
            n = len(s.text.split())
            total += n
            prose += n
            continue
        for text, links in ((visible(s.text), s.links), *((e, len(e)) for e in s.extra)) if s.extra else ((visible(s.text), s.links),):
            words = _words(text)
            if words:
                texts.append((s, text, links, len(words)))
                flat += words
    if not flat:
        return total, 0, 0, np.zeros(0, dtype=np.uint64), []
    hashes = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
    before = [0, *np.cumsum(hashes & np.uint64(1)).tolist()]  # function words up to each word
    with np.errstate(over="ignore"):
        pair = (hashes[:-1] * _MIX ^ hashes[1:]).tolist()
    end = 0
    for s, text, links, n in texts:
        at, end = end, end + n
        total += n
        linked = links >= 0.6 * len(text)
        if not linked and (n < 4 or len(text) > 8 * n) and not text.isascii() and len(_CJK.findall(text)) > 0.3 * len(text) and re.search("[。！？，]", text):
            prose += n
            continue
        share = (before[end] - before[at]) / n
        good = not linked and share >= FUNCTION_SHARE
        if n >= LONG and not linked:
            varied = len(set(pair[at : end - 1])) / (n - 1)
            if varied < 0.62:
                good = False
            elif not good and share >= 0.15 and varied > 0.8:
                good = True
        elif not good and n >= 5 and share >= 0.12 and links < 0.3 * len(text) and s.tag not in ("li", "") and text[-1:] in ".!?…" and not s.hidden:
            good = True
        if good and share < WEAK_SHARE:
            weak.append((at, end, s.hidden))
        elif good:
            prose += n
        else:
            runs.append((n, s.hidden, s.tag))
            listed += n
    if len(weak) >= MIN_PATTERN:
        pairs_of = [set(pair[at : end - 1]) for at, end, _ in weak]
        seen = Counter(chain.from_iterable(pairs_of))
        often = {x for x, c in seen.items() if c >= MIN_PATTERN}
    else:
        pairs_of, often = [()] * len(weak), None
    for (at, end, hidden), pairs in zip(weak, pairs_of):
        pattern = len(pairs & often) / len(pairs) if pairs and often else 0.0
        if pattern >= PATTERN:
            runs.append((end - at, hidden, "p"))
            listed += end - at
        else:
            prose += end - at
            if pattern >= LOOSE_PATTERN:
                loose += end - at
    if runs and prose >= 8:
        # one trailing run of tags behind prose is no list, as long as it is the smaller part
        n, hidden, tag = max((r for r in runs[-2:] if not r[1] and r[2] not in ("p", "h1", "h2", "h3")), default=(0, False, ""))
        if 0 < n < prose and sum(r[0] for r in runs if r[2] not in ("h1", "h2", "h3")) <= n + 12:
            listed -= n
            total -= n
    return total, listed, listed + loose, hashes, [n for *_, n in texts]


def _phrase_runs(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``SHINGLE`` words of each text, a shorter text being one run, and the text of each run, in order."""
    text = np.repeat(np.arange(len(size)), size)
    runs = word_runs(words, SHINGLE)
    whole = np.flatnonzero(text[: len(runs)] == text[SHINGLE - 1 :]) if len(runs) else np.zeros(0, dtype=np.int64)
    hashes, place = [runs[whole]], [whole]
    start = np.cumsum(size) - size
    for n in range(1, SHINGLE):
        at = start[size == n]
        if len(at):
            hashes.append(word_runs(words[at[:, None] + np.arange(n)].T, n)[0])
            place.append(at)
    if len(place) == 1:
        return hashes[0], text[whole]
    place = np.concatenate(place)
    order = np.argsort(place, kind="stable")
    return np.concatenate(hashes)[order], text[place[order]]


def phrase_hashes(texts: list[list[str]]) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` words of each text, in order; a shorter text is one run."""
    flat = [w for t in texts for w in t]
    return _phrase_runs(np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat)), np.array([len(t) for t in texts], dtype=np.int64))[0]


def phrase_columns(pages: list[tuple[np.ndarray, list[int]]]) -> dict:
    """``shingles, repeated, phrases`` of pages by the hashes of their words and the words of each text; every phrase of a page is kept once."""
    if not pages:
        return {"shingles": [], "repeated": [], "phrases": []}
    owner = np.repeat(np.arange(len(pages)), [len(size) for _, size in pages])
    runs, text = _phrase_runs(np.concatenate([h for h, _ in pages]), np.array([n for _, size in pages for n in size], dtype=np.int64))
    page = owner[text]
    ends = np.searchsorted(page, np.arange(len(pages) + 1)).tolist()
    for a, z in zip(ends, ends[1:]):
        runs[a:z].sort()
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:] != runs[:-1]) | (page[1:] != page[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(at, append=len(runs))
    repeated = np.bincount(page[at], np.where(counts >= MIN_REPEATS, counts, 0), len(pages)).astype(np.int32)
    offsets = np.searchsorted(page[at], np.arange(len(pages) + 1)).astype(np.int32)
    return {"shingles": np.diff(ends).astype(np.int32), "repeated": repeated, "phrases": pa.ListArray.from_arrays(offsets, runs[at].view(np.int64))}


FACTS = "fetch_id long, host string, total int, listed int, loose int, shingles int, repeated int, phrases array<long>"


def page_facts(fetched: DataFrame) -> DataFrame:
    """One row per page with its phrases and list evidence; residue pages and pages without own content have none."""
    from skeinlake.llm.residue import residue_kind

    def rows(b):
        out = {k: [] for k in ("fetch_id", "host", "total", "listed", "loose")}
        words = []
        for f, host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            page = read_page(h.as_py())
            if residue_kind(page)[0]:
                continue
            total, listed, loose, *phrases = evidence(page)
            if total:
                for k, v in zip(out, (f, host, total, listed, loose)):
                    out[k].append(v)
                words.append(phrases)
        return out | phrase_columns(words)

    return map_arrow(fetched.select("fetch_id", "host", "html"), rows, FACTS)


def summary_anchors(summaries: DataFrame) -> DataFrame:
    """``fetch_id, anchors``: words in the anchors of each page's links, the richest of repeated summaries."""
    words = F.aggregate(F.coalesce("links", F.array()), F.lit(0), lambda n, x: n + F.coalesce(F.regexp_count(x["anchor"], F.lit(r"\S+")), F.lit(0)))
    return summaries.filter(F.col("fetch_id").isNotNull()).groupBy("fetch_id").agg(F.max(words).alias("anchors"))


#: About so many phrases are counted in a task; tables of more phrases have more tasks.
TASK_PHRASES = 500_000


def _sent(parts: int):
    """Batches of facts as rows ``part, phrases, hosts, asked, by``: each phrase with its hosts, and with the fetches that ask for it.

    Within a batch a phrase has ``MIN_HOSTS`` hosts at most, since more tell nothing: no phrase makes a large task.
    """

    def rows(b):
        fetch, host, asks, lists = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
        size = lists.value_lengths().fill_null(0).to_numpy()
        # a bijection, so that the parts are ranges of the keys
        key = lists.flatten().to_numpy().view(np.uint64) * _MIX
        page = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((host[page], key))
        phrases, hosts = key[order], host[page[order]]
        keep = np.ones(len(order), dtype=bool)
        keep[1:] = (phrases[1:] != phrases[:-1]) | (hosts[1:] != hosts[:-1])
        phrases, hosts = phrases[keep], hosts[keep]
        keep = np.ones(len(phrases), dtype=bool)
        keep[MIN_HOSTS:] = phrases[MIN_HOSTS:] != phrases[:-MIN_HOSTS]
        phrases, hosts = phrases[keep], hosts[keep]
        mine = order[(asks & fetch.is_valid().to_numpy(zero_copy_only=False))[page[order]]]
        asked, by = key[mine], fetch.fill_null(0).to_numpy()[page[mine]]
        bounds = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
        a, c = np.searchsorted(phrases, bounds).tolist(), np.searchsorted(asked, bounds).tolist()
        out = {"part": [], "phrases": [], "hosts": [], "asked": [], "by": []}
        for i, (x, y, u, v) in enumerate(zip([0, *a], [*a, len(phrases)], [0, *c], [*c, len(asked)])):
            if x < y:
                for k, part in zip(out, (i, phrases[x:y].tobytes(), hosts[x:y].tobytes(), asked[u:v].tobytes(), by[u:v].tobytes())):
                    out[k].append(part)
        return out

    return rows


def _carried(batches):
    """``fetch_id, hits``: of the phrases a fetch asks for, those that ``MIN_HOSTS`` hosts have, from all rows of a part."""
    got: list[list[np.ndarray]] = [[], [], [], []]
    for b in batches:
        for g, column, kind in zip(got, b.columns, (np.uint64, np.int64, np.uint64, np.int64)):
            g.extend(np.frombuffer(x.as_buffer(), dtype=kind) for x in column)
    if not got[0]:
        return
    asked, by = np.concatenate(got[2]), np.concatenate(got[3])
    phrases = np.concatenate(got[0])
    # what comes often enough to have so many hosts and is asked for; few phrases are left for the exact count
    often = np.sort(phrases)
    often = np.unique(often[MIN_HOSTS - 1 :][often[MIN_HOSTS - 1 :] == often[: len(often) - MIN_HOSTS + 1]])
    often = np.intersect1d(often, asked)
    if not len(often):
        return
    mine = _among(phrases, often)
    phrases, hosts = phrases[mine], np.concatenate(got[1])[mine]
    order = np.lexsort((hosts, phrases))
    phrases, hosts = phrases[order], hosts[order]
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (phrases[1:] != phrases[:-1]) | (hosts[1:] != hosts[:-1])
    spread, count = np.unique(phrases[keep], return_counts=True)
    spread = spread[count >= MIN_HOSTS]
    if not len(spread):
        return
    mine = _among(asked, spread)
    asked, by = asked[mine], by[mine]
    order = np.lexsort((asked, by))
    asked, by = asked[order], by[order]
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (asked[1:] != asked[:-1]) | (by[1:] != by[:-1])
    fetch, hits = np.unique(by[keep], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(fetch), pa.array(hits)], ["fetch_id", "hits"])


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among sorted known ones."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def carried_phrases(facts: DataFrame, asks: Column) -> DataFrame:
    """``fetch_id, hits``: how many phrases of the fetches for which ``asks`` holds are on ``MIN_HOSTS`` hosts, counted over all phrases of all pages.

    Every phrase goes over the network once, with its hosts, as arrays by ranges of the phrases.
    """
    tasks = (facts.agg(F.sum("shingles")).first()[0] or 0) // TASK_PHRASES + 1
    sent = map_arrow(facts.select("fetch_id", F.xxhash64("host").alias("host"), F.coalesce(asks, F.lit(False)).alias("asks"), "phrases"), _sent(tasks), "part int, phrases binary, hosts binary, asked binary, by binary")
    found = sent.repartitionById(tasks, "part").select("phrases", "hosts", "asked", "by").mapInArrow(_carried, "fetch_id long, hits long")
    return found.groupBy("fetch_id").agg(F.sum("hits").alias("hits"))


def stuffed_pages(facts: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``fetch_id, density, carried, repeated`` of the flagged pages, from rows of ``page_facts`` (written once by the caller).

    The hosts of a phrase matter only where a page that could be flagged has it: such candidates are
    pages with half of their words in list-like segments, by the looser pattern or with the anchors.
    """
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    pages = facts.groupBy("fetch_id").agg(F.max(F.struct("total", "listed", "loose", "shingles", "repeated")).alias("x"), F.max(F.size("phrases")).alias("n")).select("fetch_id", "x.*", "n")
    if summaries is not None:
        pages = pages.join(summary_anchors(summaries), "fetch_id", "left")
    else:
        pages = pages.withColumn("anchors", F.lit(0))
    pages = pages.select(
        "fetch_id", "n", share("listed", "total").alias("density"), share("loose", "total").alias("loose"), share("repeated", "shingles").alias("repeated"), F.coalesce(share("anchors", "total"), F.lit(0.0)).alias("anchors")
    ).filter((F.col("loose") >= DENSE) | (F.col("anchors") >= LINKED) & (F.col("density") >= MIXED))
    carried = carried_phrases(facts, (share("loose", "total") >= DENSE) | (share("listed", "total") >= MIXED))
    x = pages.join(carried, "fetch_id", "left").withColumn("carried", F.coalesce("hits", F.lit(0)) / F.greatest("n", F.lit(1)))
    dense = (F.col("density") >= DENSE) & ((F.col("carried") < CARRIED) | (F.col("repeated") >= REPEATED))
    alone = (F.col("carried") < ALONE) & ((F.col("loose") >= DENSE) | (F.col("anchors") >= LINKED) & (F.col("density") >= MIXED))
    return x.filter(dense | alone).select("fetch_id", "density", "carried", "repeated")


def stuffed(fetched: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """``fetch_id, density, carried, repeated`` of keyword-stuffed and link-list pages among the fetches."""
    return stuffed_pages(written(page_facts(fetched)), summaries)
