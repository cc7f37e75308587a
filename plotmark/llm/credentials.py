"""Secrets in texts: fixed patterns, and strings that look like known credentials.

Patterns find assigned passwords and tokens, access keys and long hexadecimal runs. Their
values, labelled by kind, train one probabilistic automaton a kind; other strings of the
corpus train ordinary ones, one for each kind of characters mixed in them (see ``Scorer``).
Then every candidate of every text, a run of ``SHORTEST`` or more credential characters (the
least that a pattern takes), is scored: where its likelihood under a credential format
exceeds that under the ordinary ones by the format's margin (in natural logarithms), it is a
secret of kind ``format``, beside any span of a pattern that it touches. Candidates that lie in a
pattern's span are left to the pattern. Margins come from held-out strings.

Training uses at most ``samples`` distinct strings a kind, and as many ordinary ones for each of
15 mixes of characters, those with the least hashes over all documents, each of ``LONGEST``
characters at most; scoring knows no limit. Time is linear in a text's length. Spans count
code points, the end exclusive, and are ordered by start, then by kind as in ``KINDS``.

Null and empty texts have no spans. Rows pass through one by one, so null ids, ties and repeats
stay as they are. ``find_secrets`` reads only its two columns; ``redact`` replaces the text
column and keeps every other.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotmark.llm.automata import Automaton
from plotmark.llm.common import Memo, held, texts
from plotmark.session import materialize

KINDS = ("assign", "access", "hex", "format")
LABELS = (*KINDS[:3], "ordinary")
_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
SHORTEST, LONGEST = 6, 128
_CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
MARGIN, LEAST_MARGIN, RECALL, DOUBT = 16.0, 6.0, 0.9, 4.0
_MIX = str.maketrans(
    {c: k for k, cs in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_.=-")) for c in cs}
)
_SPANS = "array<struct<kind string, start int, end int>>"


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the fixed patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(
    text: str, spans: list[tuple[int, int, int, str]], touching: bool = True
) -> Iterator[tuple[int, int, str]]:
    """(start, end, string) of candidates that lie in no span of a pattern; of those that
    touch none if not ``touching``."""
    at, reached = 0, -1
    for m in _CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] <= m.start():
            reached = max(reached, spans[at][2])
            at += 1
        touched = reached > m.start() or at < len(spans) and spans[at][0] < m.end()
        if not touched or touching and reached < m.end():
            yield m.start(), m.end(), m[0]


def mix(text: str) -> int:
    """Which of lower and upper case letters, digits and signs a string of credential characters has, as bits."""
    if text.isalpha():
        return 1 if text.islower() else 2 if text.isupper() else 3
    return sum(1 << ord(k) for k in set(text.translate(_MIX)))


def labelled_samples(df: DataFrame, text_col: str = "text", samples: int = 400) -> dict[str, list[str]]:
    """Strings by kind: values of each pattern, and ``ordinary`` candidates outside patterns.

    Each task offers those of its rows with the least hashes, and the least of these reach
    the driver: ``samples`` a kind, and of the ordinary ones ``samples`` a mix of characters.
    """

    def least(values: dict[str, int]) -> dict[str, int]:
        return dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:samples])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
        for _, rows in texts(batches, "text"):
            for text in rows:
                spans = pattern_spans(text)
                found = {(KINDS[kind], value) for _, kind, _, value in spans}
                found.update(("ordinary", c) for _, _, c in candidates(text, spans, touching=False))
                for kind, value in found:
                    if len(value) <= LONGEST:
                        # Signed hashes must order as the unsigned ones do.
                        of = kept[kind, mix(value) if kind == "ordinary" else 0]
                        of[value] = xxhash.xxh64_intdigest(value) >> 1
                for key, values in kept.items():
                    if len(values) > 4 * samples:
                        kept[key] = least(values)
        out = [(*key, h, v) for key, values in kept.items() for v, h in least(values).items()]
        if out:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "mix", "hash", "value"])

    rows = df.select(F.col(text_col).alias("text"))
    offered = materialize(rows.mapInArrow(offer, "kind string, mix int, hash long, value string"), "samples").distinct()
    place = F.row_number().over(Window.partitionBy("kind", "mix").orderBy("hash", "value"))
    out: dict[str, list[str]] = {kind: [] for kind in LABELS}
    for r in offered.withColumn("place", place).filter(F.col("place") <= samples).orderBy("kind", "mix", "place").collect():
        out[r.kind].append(r.value)
    return out


class Scorer:
    """Tells credentials from ordinary strings by their likelihoods.

    Ordinary strings are modelled by one automaton for each mix of characters, so that numbers, addresses
    and words in capitals are each compared with their like, and by one of strings of all mixes.
    The ordinary sample comes from the same texts, so it may hold the very credentials to be
    found. Of mixes of letters with digits or signs, strings whose characters the mix's automaton makes at most ``DOUBT``
    likelier than a format does are dropped and the automaton is fitted anew, until none is left.
    If over half of a mix go, it has no automaton.

    A format's ``margin`` is the score that a share ``RECALL`` of held-out labelled values exceeds, but ``margin`` at most;
    and in any case no less than ``LEAST_MARGIN`` and the score of every held-out ordinary string. Held out
    means scored by automata fitted on the other half of the strings. ``recall`` tells which share of
    held-out values each format finds: below ``RECALL`` if its values look like ordinary strings.
    """

    def __init__(self, samples: dict[str, list[str]], margin: float = MARGIN):
        labelled = [samples[k] for k in LABELS[:3] if samples.get(k)]
        self.formats = [Automaton(values) for values in labelled]
        ordinary = samples.get("ordinary", [])
        self.pooled = Automaton(_spread(ordinary))
        self.by_mix: dict[int, Automaton] = {}
        kept: dict[int, list[str]] = {}
        for m in sorted(set(map(mix, ordinary))):
            kept[m] = [c for c in ordinary if mix(c) == m]
            # Letters alone are words, digits alone numbers: passwords like them must not make all words look like passwords.
            if m & 3 and m & 12:
                kept[m] = self._without_credentials(kept[m])
            if kept[m]:
                self.by_mix[m] = Automaton(kept[m])
        # Where every string of every mix looks like a credential, nothing can be told apart.
        if self.by_mix:
            self.pooled = Automaton(_spread([c for values in kept.values() for c in values]))
        noise = self._held_out_noise(kept)
        self.margins, self.recall = [], []
        for values, floor in zip(labelled, noise):
            scores = sorted(self._held_out_scores(values))
            wanted = scores[int((1 - RECALL) * len(scores))] - 1e-9 if scores else margin
            self.margins.append(max(min(margin, wanted), floor, LEAST_MARGIN))
            self.recall.append(sum(x > self.margins[-1] for x in scores) / len(scores) if scores else 0.0)
        self._best = [0.0]
        self._reach = [[0.0] * len(f.scores) for f in self.formats]

    def _without_credentials(self, strings: list[str]) -> list[str]:
        left = strings
        # Of a mix that is mostly credentials, the rest are its odd ones.
        while 2 * len(left) > len(strings):
            model = Automaton(left)
            plain = [c for c in left if not self._like_a_format(c, model.log_prefix(c))]
            if len(plain) == len(left):
                return left
            left = plain
        return []

    def _like_a_format(self, text: str, base: float) -> bool:
        return any(f.log_prefix(text) > base - DOUBT for f in self.formats)

    def _held_out_scores(self, values: list[str]) -> list[float]:
        """Scores of a format's values by automata of the other half; none for a single value."""
        halves = values[::2], values[1::2]
        fitted = [Automaton(h) for h in halves]
        if not halves[1]:
            return []
        return [fitted[1 - k].log_probability(v) - self.ordinary(v) for k in (0, 1) for v in halves[k]]

    def _held_out_noise(self, kept: dict[int, list[str]]) -> list[float]:
        """Each format's highest score of an ordinary string that did not teach."""
        noise = [0.0] * len(self.formats)
        for strings in kept.values():
            halves = strings[::2], strings[1::2]
            fitted = [Automaton(h) for h in halves]
            for k in (0, 1):
                # A mix of few strings says nothing of strings that did not teach.
                for c in halves[k] if len(strings) >= 20 else ():
                    base = fitted[1 - k].log_probability(c)
                    noise = [max(n, f.log_probability(c) - base) for n, f in zip(noise, self.formats)]
        return noise

    def ordinary(self, text: str) -> float:
        """Log likelihood as an ordinary string."""
        own = self.by_mix.get(mix(text))
        pooled = self.pooled.log_probability(text)
        return pooled if own is None else max(pooled, own.log_probability(text))

    def score(self, text: str) -> float:
        """Log likelihood of the best format over that as an ordinary string."""
        best = max((f.log_probability(text) for f in self.formats), default=float("-inf"))
        return best - self.ordinary(text)

    def _most(self, length: int) -> float:
        """No string of a length has a higher log likelihood under any format."""
        while len(self._best) <= length:
            # The best continuation from each state, one character longer than before; then the same for a start.
            for k, f in enumerate(self.formats):
                old = self._reach[k]
                self._reach[k] = [
                    max([p + old[f.next[s][c]] for c, p in steps.items()] + [f.unseen + old[0]])
                    for s, (steps, _) in enumerate(f.scores)
                ]
            self._best.append(max((r[0] for r in self._reach if r), default=float("-inf")))
        return self._best[length]

    def is_secret(self, text: str) -> bool:
        own = self.by_mix.get(mix(text))
        # Most words end here: no string of their length could be so much likelier.
        if own is not None and len(text) <= LONGEST and self._most(len(text)) - own.log_probability(text) <= LEAST_MARGIN:
            return False
        base = self.ordinary(text)
        return any(f.log_probability(text) - base > m for f, m in zip(self.formats, self.margins))


def _spread(strings: list[str], most: int = 400) -> list[str]:
    """At most ``most`` of the strings, evenly over their order."""
    step = max(1, -(-len(strings) // most))
    return strings[::step]


def _finder(spark: SparkSession, samples: dict[str, list[str]], margin: float) -> Callable[[str], list[dict]]:
    """A function of a text that gives its spans; what it ships is bounded by the samples."""
    shared = spark.sparkContext.broadcast(Scorer(samples, margin))
    name = xxhash.xxh3_128_hexdigest(repr((sorted(samples.items()), margin)))

    def judge() -> Memo:
        return Memo(lambda c: shared.value.is_secret(c), limit=200_000)

    def find(text: str) -> list[dict]:
        is_secret = held(("formats", name), judge)
        spans = pattern_spans(text)
        more = [(s, 3, e, "") for s, e, c in candidates(text, spans) if is_secret[c]]
        return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in sorted(spans + more)]

    return find


def find_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 400, margin: float = MARGIN
) -> DataFrame:
    """(id, spans) per row; the formats are learned from the same table."""
    find = _finder(df.sparkSession, labelled_samples(df, text_col, samples), margin)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch, rows in texts(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find(t) for t in rows], kind)], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, spans {_SPANS}").withColumnRenamed("id", id_col)


def redact(
    df: DataFrame, text_col: str = "text", mark: str = "[secret]", samples: int = 400, margin: float = MARGIN
) -> DataFrame:
    """The table with each secret replaced by ``mark``; overlapping spans are one."""
    find = _finder(df.sparkSession, labelled_samples(df, text_col, samples), margin)

    @F.arrow_udf("string")
    def cleaned(column: pa.Array) -> pa.Array:
        return pa.array([t if t is None else _without(t, find(t), mark) for t in column.to_pylist()], pa.string())

    return df.withColumn(text_col, cleaned(F.col(text_col)))


def _without(text: str, spans: list[dict], mark: str) -> str:
    parts, at = [], 0
    for span in spans:
        if span["start"] >= at:
            parts += [text[at : span["start"]], mark]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
