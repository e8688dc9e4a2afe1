"""Toxicity of texts whose words may be disguised.

Words that hold look-alike characters, repeated letters or letters spelled apart
become lattices of the characters they may stand for, which are decoded under a
character trigram model of the whole corpus (a noisy channel). The restored words
are scored by evidence that labelled documents give: whole words and word
beginnings that are far more frequent in toxic documents than chance allows. The
evidence words also join the character model, as words that are worth reading.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import char_model
from tidemark.llm.labelled import SAMPLE_ROWS, labelled_texts
from tidemark.llm.quality import BoostedTrees, fit_trees
from tidemark.llm.recent import Recent
from tidemark.session import snapshot

# Characters that stand for letters.
LOOK_ALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
#: Costs of having written a letter that way (natural logarithms).
SWAPPED, DOUBLED, REPEATED, SPACED = 1.0, 4.0, 0.5, 1.0

#: Three or more single characters, each apart from the next by one blank.
APART = re.compile(r"(?<!\S)[^\W_](?:[ \t][^\W_]){2,}(?!\S)")
#: The same inside one word, apart by marks.
DOTTED = re.compile(r"[^\W_](?:[._*~-][^\W_]){2,}")
EDGE = ".,;:?\"'()[]{}<>*#%&~=_-/\\"
STUCK = re.compile(r"(.)\1")
SUSPECT = re.compile("[" + re.escape("".join(LOOK_ALIKE)) + "]")
#: Marks a run of single letters as one token.
JOINED = "\x00"

SHORTEST, LONGEST = 4, 7
GROUP_CHARS, KNOWN_WORDS = 1 << 21, 150_000
#: Weight of the evidence words in the character model, as a share of its words.
LEXICON_SHARE = 0.02


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; a run of single characters is one token."""
    low = text.lower()
    if APART.search(low):
        low = APART.sub(lambda m: JOINED + m[0][::2], low)
    return low.split()


def cores(token: str) -> list[str]:
    """The ways to read where a token's word begins and ends.

    Marks at the edges are no letters, but some of them stand for letters elsewhere.
    A word is read without them and, where they may be disguise, with them as well.
    """
    if token.startswith(JOINED):
        return [token]
    bare = token.strip(EDGE)
    core = bare.rstrip("!$+|")
    tail = bare[len(core) :]
    opened = token[: len(token) - len(token.lstrip(EDGE))].endswith("(") and ")" not in token
    # An exclamation mark at the end is one.
    told = any(c in "$+|" for c in tail)
    if not (opened or told) or not any(map(str.isalpha, core)):
        return [core]
    return [core, ("(" if opened else "") + core + tail]


def lattice(core: str) -> list[list[char_model.Candidate]] | str:
    """The candidates of each position of a disguised core, or the plain word that another one is."""
    apart = core.startswith(JOINED)
    core = core[1:] if apart else core
    if not apart and DOTTED.fullmatch(core):
        apart, core = True, core[::2]
    disguised = SUSPECT.search(core) is not None and any(map(str.isalpha, core))
    if not (apart or disguised or STUCK.search(core)):
        return core
    positions: list[list[char_model.Candidate]] = []
    at = 0
    while at < len(core):
        char, end = core[at], at + 1
        if not apart:
            while end < len(core) and core[end] == char:
                end += 1
        options = [(char, 0.0)]
        if disguised or apart:
            options += [(letter, SWAPPED) for letter in LOOK_ALIKE.get(char, "")]
        if end - at == 2:
            options = [(c + c, p) for c, p in options] + [(c, p + DOUBLED) for c, p in options]
        elif end - at > 2:
            options = [(c, p + REPEATED) for c, p in options] + [(c + c, p + REPEATED) for c, p in options]
        if apart and at:
            options = [(" " + c, p) for c, p in options] + [(c, p + SPACED) for c, p in options]
        positions.append(options)
        at = end
    return positions


def restored(model: np.ndarray, tokens: Iterable[str]) -> dict[str, list[str]]:
    """The words that each token is read as."""
    found: dict[str, list[str]] = {}
    pending, lattices = [], []
    for token in tokens:
        found[token] = []
        for core in cores(token):
            read = lattice(core)
            if isinstance(read, str):
                found[token].append(read)
            else:
                pending.append(token)
                lattices.append(read)
    for token, read in zip(pending, char_model.viterbi(model, lattices), strict=True):
        found[token] += read.split()
        if token.startswith(JOINED):
            # Letters apart are also read as one word.
            found[token].append(token[1:])
    return found


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, which carry a mark."""
    return [word, *(f"^{word[:k]}" for k in range(SHORTEST, LONGEST + 1) if len(word) >= k)]


#: What a document's hits amount to, in the order of ``ToxicityModel.summary``.
SUMMARY = ("best_word", "best_beginning", "hits", "distinct_hits", "strength", "hit_share", "top_beginning", "top_beginning_share", "log_tokens")
#: A word that only toxic documents hold may be as frequent as this in clean ones, with a chance of one in a thousand (-log 0.001).
HIDDEN = 7.0


@dataclass
class ToxicityModel:
    """Character model, evidence (log odds and sure share of each feature), and trees over a document's summary."""

    characters: np.ndarray
    evidence: dict[str, tuple[float, float]]
    trees: BoostedTrees

    def __post_init__(self) -> None:
        self.starts = {feature[1 : SHORTEST + 1] for feature in self.evidence if feature.startswith("^")}

    def hit(self, words: list[str]) -> tuple[float, float, float, str] | None:
        """Log odds of the best word and the best beginning, the sure share, and the beginning; None without evidence."""
        evidence, starts = self.evidence, self.starts
        found = {f: evidence[f] for word in words if word in evidence or word[:SHORTEST] in starts for f in features_of(word) if f in evidence}
        if not found:
            return None
        begun = {f: e[0] for f, e in found.items() if f.startswith("^")}
        whole = max((e[0] for f, e in found.items() if f not in begun), default=0.0)
        return whole, max(begun.values(), default=0.0), max(e[1] for e in found.values()), min(begun, key=lambda f: (len(f), f), default="")

    def summary(self, tokens: list[str], known: dict[str, tuple | None]) -> tuple[list[float], float]:
        """The summary of a document (see ``SUMMARY``) and the surest share of toxic documents among those with one of its words."""
        hit_tokens = [t for t in tokens if known[t] is not None]
        if not hit_tokens:
            return [0.0] * len(SUMMARY), 0.0  # alike for all texts, so that length alone proves nothing
        hits = [known[t] for t in hit_tokens]
        top = max(Counter(h[3] for h in hits if h[3]).values(), default=0)
        strength = sum(max(h[0], h[1]) for h in hits)
        n = len(tokens)
        row = [max(h[0] for h in hits), max(h[1] for h in hits), len(hits), len(set(hit_tokens)), strength, len(hits) / n, top, top / n, math.log1p(n)]
        return row, max(h[2] for h in hits)

    def summaries(self, texts: Iterable[str]) -> Iterator[tuple[list[float], float]]:
        recent = Recent(KNOWN_WORDS)
        for group in grouped(texts):
            new = recent.missing(set().union(*group))
            for token, words in restored(self.characters, new).items():
                recent.known[token] = self.hit(words)
            for tokens in group:
                yield self.summary(tokens, recent.known)

    def probabilities(self, texts: Iterable[str]) -> np.ndarray:
        """What the trees say of the summary, but no less than the surest single word."""
        found = list(self.summaries(texts))
        x = np.array([row for row, _ in found], np.float64).reshape(-1, len(SUMMARY))
        return np.maximum(self.trees.probability(x), np.array([sure for _, sure in found], np.float64))


def grouped(texts: Iterable[str]) -> Iterator[list[list[str]]]:
    """The tokens of texts, of about ``GROUP_CHARS`` characters at a time."""
    group: list[list[str]] = []
    size = 0
    for text in texts:
        group.append(tokens_of(text))
        size += len(text)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _feature_counts(sample: DataFrame, characters: np.ndarray) -> DataFrame:
    """(``feature``, ``n``, ``toxic``): labelled documents that have each feature, and the toxic ones of them."""
    shared = sample.sparkSession.sparkContext.broadcast(characters)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def emit() -> pa.RecordBatch:
            n, toxic = zip(*counts.values(), strict=True) if counts else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64())], names=["feature", "n", "toxic"])

        for batch in batches:
            labels = iter(batch.column(1).to_pylist())
            for group in grouped(text.as_py() or "" for text in batch.column(0)):
                words = restored(shared.value, set().union(*group))
                for tokens in group:
                    label = next(labels)
                    for feature in {f for token in set(tokens) for word in words[token] for f in features_of(word)}:
                        count = counts.setdefault(feature, [0, 0])
                        count[0] += 1
                        count[1] += label
                if len(counts) > KNOWN_WORDS:
                    yield emit()
                    counts.clear()
        yield emit()

    parts = sample.select("text", "label").mapInArrow(tasks, "feature string, n long, toxic long")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _evidence(counts: DataFrame, share: float) -> dict[str, tuple[float, float]]:
    """Log odds of the features that chance would hardly give, and, for words no clean document holds, a lower bound of the toxic share.

    The chance of so many toxic documents is bounded by exp(-n * KL); times the
    number of features that were looked at it has to stay below one in twenty.
    """
    seen = counts.filter("n >= 3").count()
    rate = F.lit(share)
    part = F.col("toxic") / F.col("n")
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - rate))).otherwise(0.0)
    surprise = F.col("n") * (part * F.log(part / rate) + rest)
    strong = counts.filter((F.col("toxic") >= 3) & (part >= 0.5)).filter(surprise > math.log(20 * max(seen, 1)))
    clean = F.col("n") - F.col("toxic")
    odds = F.log((F.col("toxic") + 0.2) / (clean + 0.2)) - math.log(share / (1 - share))
    alone = (clean == 0) & ~F.col("feature").startswith("^")
    sure = F.when(alone, F.greatest(1 - HIDDEN / F.col("n"), F.lit(0.0))).otherwise(0.0)
    return {r.feature: (r.odds, r.sure) for r in strong.select("feature", odds.alias("odds"), sure.alias("sure")).collect()}


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, *, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model of ``labels.toxic``.

    The character model counts all texts of ``docs``; labels come from at most
    ``sample_rows`` usable labelled documents (see ``labelled_texts``). Without
    labelled rows of both kinds every text gets the share of toxic ones, with one
    clean document assumed if there are none at all: nothing is toxic unlearned.
    """
    counts = char_model.count_trigrams(docs)
    plain = char_model.log_probabilities(counts)
    sample = labelled_texts(docs, labels, "toxic", usable, sample_rows=sample_rows)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < total:
        return ToxicityModel(plain, {}, fit_trees(np.zeros((max(total, 1), len(SUMMARY))), np.full(max(total, 1), float(toxic > 0))))
    evidence = _evidence(snapshot(_feature_counts(sample, plain)), toxic / total)
    lexicon = counts.astype(np.float64)
    if evidence:
        each = max(1.0, LEXICON_SHARE * counts.reshape(-1, char_model.SIZE).sum(axis=0)[0] / len(evidence))
        for feature in evidence:
            # The beginning of a word ends without a boundary.
            whole = char_model.trigrams(feature.lstrip("^"))
            np.add.at(lexicon, whole[:-1] if feature.startswith("^") else whole, each)
    model = ToxicityModel(char_model.log_probabilities(lexicon), evidence, fit_trees(np.zeros((0, len(SUMMARY))), np.zeros(0)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for row, _ in shared.value.summaries(text.as_py() or "" for text in batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    rows = sample.select("text", "label").mapInArrow(tasks, "label int, x array<double>").toArrow()
    x, y = np.array(rows.column("x").to_pylist(), np.float64), rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))
    model.trees = fit_trees(x[order], y[order], trees=40, depth=3)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``score``, the probability of being toxic.

    Null, empty and blank texts show no evidence and are scored like any other.
    Other columns are not read; repeated rows are scored each. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.probabilities(text.as_py() or "" for text in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id long, score double")
