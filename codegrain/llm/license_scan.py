"""Licence scans: parts of a text compared with licence templates by the Dice coefficient of their word bigrams.

Normalised, a text is its runs of a-z and 0-9 in lower case. Its parts are the whole, the paragraphs (between blank lines),
the lines, and, for each template, the runs of as many words as the template has that begin with one of its bigrams,
wherever lines end. The bigrams of a part are a set. Two sets of sizes m and u that share c have a Dice coefficient of
2 c / (m + u), and c is at most the smaller, so for a threshold t no part of less than t / (2 - t) times m shared bigrams
can match a template of m: a template with fewer hits in the whole text is not looked at, and no part with fewer. Of matches
that overlap the closest counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.license_templates import TEMPLATES

_WORDS = re.compile(r"[a-z0-9]+").findall
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

Templates = dict[str, tuple[str, ...]]


class Matcher:
    def __init__(self, templates: Templates, threshold: float):
        self.threshold = threshold
        share = threshold / (2 - threshold)
        texts = [(name, _WORDS(text.lower())) for name, some in templates.items() for text in some]
        texts = [(name, words) for name, words in texts if len(words) > 1]
        self.names = [name for name, _ in texts]
        self.lengths = [len(words) - 1 for _, words in texts]
        self.ids = {w: i for i, w in enumerate(sorted({w for _, words in texts for w in words}))}
        n = len(self.ids)
        held = [sorted({self.ids[a] * n + self.ids[b] for a, b in zip(words, words[1:], strict=False)}) for _, words in texts]
        self.sizes = np.array([len(x) for x in held], np.int64)
        self.need = np.ceil(share * self.sizes - 1e-9).astype(np.int64)
        codes = sorted({c for x in held for c in x})
        #: place of a pair of words among all bigrams of templates, and which templates have it
        self.place = np.full(n * n, -1, np.int32)
        self.place[codes] = np.arange(len(codes))
        self.has = np.zeros((len(codes), len(held)), bool)
        for t, x in enumerate(held):
            self.has[self.place[x], t] = True

    def find(self, text: str) -> list[tuple[float, str, int, int]]:
        """(Dice, name, first word, word after the last) of the matches, best first; of those that overlap only the one
        that comes first by Dice, name and place, and none that overlaps a better one."""
        words = _WORDS(text.lower())
        if len(words) < 2 or not self.names:
            return []
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        inside = (ids[:-1] >= 0) & (ids[1:] >= 0)
        place = np.where(inside, self.place[np.where(inside, ids[:-1] * len(self.ids) + ids[1:], 0)], -1)
        at = np.flatnonzero(place >= 0)
        live = np.flatnonzero(np.bincount(place[at], minlength=len(self.has)) @ self.has >= self.need)
        if not len(live):
            return []
        before = _before(words)
        parts = _parts(text, len(words))
        close: set[tuple[float, str, int, int]] = set()
        for t in live:
            hits = at[self.has[place[at], t]]
            windows = np.stack([hits, np.minimum(hits + self.lengths[t], len(words) - 1)], axis=1)
            spans = np.concatenate([parts, windows])
            enough = np.searchsorted(hits, spans[:, 1]) - np.searchsorted(hits, spans[:, 0]) >= self.need[t]
            for start, stop in np.unique(spans[enough], axis=0).tolist():
                common = int((before[hits[np.searchsorted(hits, start) : np.searchsorted(hits, stop)]] < start).sum())
                if common < self.need[t]:
                    continue
                dice = 2.0 * common / int(self.sizes[t] + (before[start:stop] < start).sum())
                if dice >= self.threshold:
                    close.add((-dice, self.names[t], start, stop + 1))
        covered, out = np.zeros(len(words), bool), []
        for dice, name, start, stop in sorted(close):
            if not covered[start:stop].any():
                out.append((-dice, name, start, stop))
            covered[start:stop] = True
        return out


def _before(words: list[str]) -> np.ndarray:
    """For each bigram the place where it occurred last, -1 for the first time: a part's bigrams that did not occur since
    its start are its set."""
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    order = np.argsort(pairs, kind="stable")
    out = np.full(len(pairs), -1, np.int64)
    same = pairs[order[1:]] == pairs[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _parts(text: str, n_words: int) -> np.ndarray:
    """Ranges of bigrams of the whole text, its paragraphs and its lines."""
    low, out = text.lower(), [(0, n_words - 1)]
    for pieces in (low.split("\n"), _PARAGRAPH.split(low)):
        ends = np.cumsum([len(_WORDS(x)) for x in pieces])
        out += [(int(a), int(b) - 1) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if b - a > 1]
    return np.array(out, np.int64)


MATCHES = "array<struct<license:string,dice:double,first_word:long,n_words:long>>"


def matches(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Per document (doc_id, text): doc_id, matches (licence, Dice coefficient, first word from 0, number of words), best
    first. Null and empty texts, and those without a match, have an empty list. Whole texts are scanned; repeated rows each
    get a row; other columns are ignored; no documents, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(templates, threshold).find
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            found = [[{"license": name, "dice": dice, "first_word": a, "n_words": b - a} for dice, name, a, b in find(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, matches {MATCHES}")


def scan(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """What matches() finds as doc_id, licenses (names in order, comma-separated, '' for none), n_licenses, best_dice (null
    for none)."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    found = matches(docs, templates, threshold)
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"), F.array_max(F.transform("matches", lambda m: m["dice"])).alias("best_dice"))


def oracle(templates: Templates = TEMPLATES, threshold: float = 0.8) -> str:
    """scan() in DuckDB SQL."""
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate((n, t) for n, some in templates.items() for t in some))
    words = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    pairs = "list_transform(range(1, greatest(len({0}), 1)), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return f"""
WITH templates(tid, name, body) AS (VALUES {rows}
), worded AS (
  SELECT tid, name, {words.format("body")} AS w FROM templates
), asked AS (
  SELECT tid, name, len(w) - 1 AS length, list_distinct({pairs.format("w")}) AS b, ceil({threshold}::DOUBLE / (2 - {threshold}::DOUBLE) * len(list_distinct({pairs.format("w")})) - 1e-9) AS need FROM worded
), asked_pairs AS (
  SELECT tid, unnest(b) AS pair FROM asked
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents
), listed AS (
  SELECT k, {pairs.format("w")} AS p FROM docs
), placed AS (
  SELECT k, unnest(p) AS pair, unnest(range(len(p))) AS i FROM listed
), pairs AS (
  SELECT k, pair, i, coalesce(lag(i) OVER (PARTITION BY k, pair ORDER BY i), -1) AS last FROM placed
), hits AS (
  SELECT k, tid, i, last FROM pairs JOIN asked_pairs USING (pair)
), live AS (
  SELECT k, tid FROM hits JOIN asked USING (tid) GROUP BY k, tid, need HAVING count(*) >= need
), pieces AS (
  SELECT k, 1 AS kind, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS nth FROM docs WHERE k IN (SELECT k FROM live)
  UNION ALL SELECT k, 2, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), unnest(range(len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')))) FROM docs WHERE k IN (SELECT k FROM live)
  UNION ALL SELECT k, 3, text, 0 FROM docs WHERE k IN (SELECT k FROM live)
), counted AS (
  SELECT k, kind, nth, len({words.format("piece")}) AS n FROM pieces
), ranged AS (
  SELECT k, n, sum(n) OVER (PARTITION BY k, kind ORDER BY nth) AS e FROM counted
), spans AS (
  SELECT k, tid, CAST(e - n AS BIGINT) AS s, CAST(e - 1 AS BIGINT) AS e FROM live JOIN ranged USING (k) WHERE n > 1
  UNION SELECT k, tid, i, least(i + length, len(w) - 1) FROM hits JOIN live USING (k, tid) JOIN asked USING (tid) JOIN docs USING (k)
), common AS (
  SELECT k, tid, s, e, count(*) AS c FROM spans JOIN hits USING (k, tid) WHERE i >= s AND i < e AND last < s GROUP BY ALL
), enough AS (
  SELECT k, tid, s, e, c, name, len(b) AS m FROM common JOIN asked USING (tid) WHERE c >= need
), measured AS (
  SELECT k, tid, s, e, c, name, m, count(*) AS u FROM enough JOIN pairs USING (k) WHERE i >= s AND i < e AND last < s GROUP BY ALL
), close AS (
  SELECT DISTINCT k, name, s, e + 1 AS e, 2.0::DOUBLE * c / (m + u) AS dice FROM measured WHERE 2.0::DOUBLE * c / (m + u) >= {threshold}
), best AS (
  SELECT * FROM close x WHERE NOT EXISTS (SELECT 1 FROM close y WHERE y.k = x.k AND y.s < x.e AND x.s < y.e AND (-y.dice, y.name, y.s, y.e) < (-x.dice, x.name, x.s, x.e))
), found AS (
  SELECT k, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT name) AS n, max(dice) AS best_dice FROM best GROUP BY k
)
SELECT doc_id, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, best_dice FROM docs LEFT JOIN found USING (k)
"""
