"""Subject areas of each document, by classifier chains.

Documents are cut into sentences and terms once, into a table of hashed terms. Term weights for each subject are first learned from hand-labelled
documents, then from the sentences of the whole corpus, in which a term counts for the subject that the terms beside it tell. Features of a
document are the shares and scores of its sentences, the subjects usual in its source, and its structure. A chain of calibrated logistic
classifiers, one for each subject with coefficients of its own and each seeing which labels came before it, is decoded by beam search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.words import CJK, words
from mnemoframe.runtime import checkpointed, few_rows

#: Labelled documents the model is fitted on: those with the smallest hashes, at most so many.
MOST_LABELLED = 20_000
#: Terms whose weights a task holds at a time (48 bytes each); more are applied block after block.
TERMS_PER_BLOCK = 1 << 20
#: Terms of documents that are scored at once.
TERMS_PER_PART = 1 << 16
#: A sentence is about a subject if the log odds against the common language reach this.
SENTENCE_ODDS = 3.0
BEAM = 8
#: Log odds that the other terms of a sentence must reach to teach a term its subject.
OTHERS_ODDS = 1.8
_ROUNDS = 3
#: How strongly a subject's own coefficients are held to those fitted over all subjects.
OWN_RIDGE = 4.0
#: Where the response to the share of sentences may bend.
_KNOTS = np.array([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6])
_HEADER = re.compile(r"^\s*(?:#|\{)")
_CJK_RUN = re.compile(f"[{CJK}]+")
# a stop, maybe quoted, or a closing quotation mark, then space and something that is no small letter
_STOP = re.compile(r"(?<=[.!?])[\"”»]?\s+(?=[^a-z\s])|(?<=[\"”»])\s+(?=[^\W\d_a-z])|(?<=[。！？])")
_LETTERS = re.compile(r"[^\W\d_]{2}|" + f"[{CJK}]")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: parts that end with a stop, a closing quotation before a capital letter, or a line; headings and parts without letters are none."""
    out = []
    for line in (text or "").split("\n"):
        if not _HEADER.match(line):
            out += [part for part in _STOP.split(line) if part and _LETTERS.search(part)]
    return out


def terms(sentence: str) -> list[str]:
    """Its words, and the pairs of neighbours in runs of CJK characters in place of single ones."""
    out = [w for w in words(sentence) if not ("぀" <= w[0] <= "鿿") and len(w) > 1 and not w.isdigit()]
    for run in _CJK_RUN.findall(sentence):
        out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def _hashed(sentence: str, known: dict[str, int]) -> list[int]:
    """Its different terms as even hashes; one is added to those found more than once."""
    found: dict[int, int] = {}
    for t in terms(sentence):
        h = known.get(t)
        if h is None:
            h = known[t] = (xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 << 1) - 2**63
        found[h] = 1 if h in found else 0
    return [h + more for h, more in found.items()]


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, source, sizes, terms) of each different row with a text that is not blank: the number of terms of each sentence, and all terms."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.filter("doc_id is not null").select("doc_id", "text", F.col("doc_kind").alias("kind"), "source")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[lo : lo + 1000] for whole in batches for lo in range(0, len(whole), 1000)):
            known: dict[str, int] = {}  # of these rows only
            parts = [[_hashed(s, known) for s in sentences(t)] if t and t.strip() else None for t in batch["text"]]
            ok = [p is not None for p in parts]
            kept = [p for p in parts if p is not None]
            yield batch.loc[ok, ["doc_id", "kind", "source"]].assign(sizes=[[len(s) for s in p] for p in kept], terms=[[t for s in p for t in s] for p in kept])

    return checkpointed(rows.mapInPandas(run, f"doc_id {kind}, kind string, source string, sizes array<int>, terms array<long>"))


@dataclass
class _Batch:
    """Rows of tokenised() as flat arrays: the sentence of each term, the document of each sentence."""

    term: np.ndarray
    twice: np.ndarray
    sent: np.ndarray
    doc: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, batch: pd.DataFrame) -> _Batch:
        sizes = [np.asarray(s, np.int64) for s in batch["sizes"]]
        flat = np.concatenate([np.asarray(t, np.int64) for t in batch["terms"]]) if len(batch) else np.empty(0, np.int64)
        per = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        return cls(flat & ~1, (flat & 1) + 1, np.repeat(np.arange(len(per)), per), np.repeat(np.arange(len(sizes)), [len(s) for s in sizes]), len(sizes))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of tokenised() in parts of about TERMS_PER_PART terms, one row at least."""
    for batch in batches:
        if len(batch):
            part = np.cumsum([len(t) for t in batch["terms"]]) // TERMS_PER_PART
            for lo, hi in zip((starts := np.flatnonzero(np.r_[True, part[1:] != part[:-1]])), [*starts[1:], len(part)]):
                yield batch.iloc[lo:hi].reset_index(drop=True)


class Lexicon:
    """Log odds of each known term for each subject against an even chance, in broadcast blocks of TERMS_PER_BLOCK terms."""

    def __init__(self, counts: DataFrame, k: int, least: float, share: float, where: str = "true") -> None:
        """counts is (term, at, n[, m]): how often a term counted for a subject. Terms with at least so many counts, of which one subject has the share, get weights."""
        self.k = k
        per = counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("by"), F.sum("n").alias("total"), F.max(F.struct(*[c for c in ("n", "m") if c in counts.columns])).alias("top"), *([F.sum("m").alias("around")] if "m" in counts.columns else []))
        kept = checkpointed(per.filter(F.col("total") >= least).filter((F.col("top.n") + 1.0 / k) / (F.col("total") + 1.0) >= share).filter(where).select("term", "by"))
        n = kept.count()
        parts = -(-n // TERMS_PER_BLOCK)
        self.blocks = []
        for part in range(parts):
            own = kept.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toPandas().sort_values("term")
            c = np.zeros((len(own), k))
            for row, by in enumerate(own["by"]):
                for at, v in by.items():
                    c[row, at] = v
            w = np.clip(np.log((c + 1.0 / k) / (c.sum(axis=1, keepdims=True) + 1.0) * k), -1.0, 2.5).astype(np.float32)
            self.blocks.append(kept.sparkSession.sparkContext.broadcast((own["term"].to_numpy(np.int64), w)))

    def weights(self, term: np.ndarray) -> np.ndarray:
        """One row for each term, zeros for unknown ones."""
        out = np.zeros((len(term), self.k), np.float32)
        for block in self.blocks:
            known, w = block.value
            at = np.minimum(np.searchsorted(known, term), len(known) - 1)
            hit = known[at] == term
            out[hit] = w[at[hit]]
            if len(self.blocks) > 1 and hasattr(block, "_value"):
                del block._value  # hold one block at a time
        return out

    def odds(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """(of each term, what it adds to its sentence; of each sentence the sum)."""
        added = self.weights(b.term) * b.twice[:, None].astype(np.float32)
        total = np.zeros((len(b.doc), self.k), np.float32)
        np.add.at(total, b.sent, added)
        return added, total


def _labelled_counts(tokens: DataFrame, by_doc: DataFrame) -> DataFrame:
    """(term, at, n): a document counts for each of its labels in part."""
    each = tokens.join(by_doc, "doc_id").select(F.explode(F.array_distinct(F.transform("terms", lambda t: t.bitwiseAND(F.lit(-2).cast("long"))))).alias("term"), "labels")
    return each.select("term", F.explode("labels").alias("at"), (1.0 / F.size("labels")).alias("n")).groupBy("term", "at").agg(F.sum("n").alias("n"))


def _taught_counts(tokens: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(term, at, n, m) over all sentences of the corpus: n counts for a term the subject that the other terms of its sentence tell, m the one that
    the other sentences of its document are about most. Summed in each batch before the one shuffle."""
    k = lexicon.k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            b = _Batch.of(batch)
            if not len(b.term):
                continue
            added, total = lexicon.odds(b)
            best = total.argmax(axis=1)
            best = np.where(total[np.arange(len(best)), best] >= SENTENCE_ODDS, best, -1)
            around = np.zeros((b.n_docs, k), np.int32)
            np.add.at(around, (b.doc[best >= 0], best[best >= 0]), 1)
            others = around[b.doc]
            others[np.flatnonzero(best >= 0), best[best >= 0]] -= 1
            beside = np.where(others.any(axis=1), others.argmax(axis=1), -1)[b.sent]
            rest = total[b.sent] - added
            told = rest.argmax(axis=1)
            told = np.where(rest[np.arange(len(told)), told] >= OTHERS_ODDS, told, -1)
            n = pd.DataFrame({"term": b.term, "at": told, "n": 1, "m": 0})[told >= 0]
            m = pd.DataFrame({"term": b.term, "at": beside, "n": 0, "m": 1})[beside >= 0]
            yield pd.concat([n, m]).groupby(["term", "at"], as_index=False).sum()

    return tokens.select("sizes", "terms").mapInPandas(run, "term long, at int, n long, m long").groupBy("term", "at").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


KINDS = ("transcript", "summary", "fact_list", "note", "file")


def features(lexicon: Lexicon, batch: pd.DataFrame, usual: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, subjects, features): share of sentences and how far it is over each knot, number, mean odds, distance to the largest share, rate in the source; then structure."""
    b, k = _Batch.of(batch), lexicon.k
    _, total = lexicon.odds(b)
    best = total.argmax(axis=1) if len(total) else np.empty(0, int)
    value = total[np.arange(len(best)), best]
    hit = value >= SENTENCE_ODDS
    hits, odds = np.zeros((b.n_docs, k)), np.zeros((b.n_docs, k))
    np.add.at(hits, (b.doc[hit], best[hit]), 1)
    np.add.at(odds, (b.doc[hit], best[hit]), np.minimum(value[hit], 20))
    n = np.maximum(1, np.bincount(b.doc, minlength=b.n_docs))[:, None]
    share = hits / n
    rate = np.array([usual.get(s or "", usual[""]) for s in batch["source"]]).reshape(-1, k)
    bends = np.maximum(0, share[:, :, None] + 1e-9 - _KNOTS) * 10
    own = np.stack([share, hits > 0, hits == 1, np.minimum(hits, 3) / 3, odds / np.maximum(hits, 1) / 20, share.max(axis=1, keepdims=True) - share, rate], axis=2)
    structure = np.concatenate([np.ones((b.n_docs, 1)), np.log1p(n) / 3, hits.sum(axis=1, keepdims=True) / n, np.array([[float(x == y) for y in KINDS] for x in batch["kind"]]).reshape(-1, len(KINDS))], axis=1)
    return np.concatenate([own, bends, np.repeat(structure[:, None], k, axis=1)], axis=2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, around: np.ndarray | None = None) -> np.ndarray:
    """Coefficients by Newton steps, drawn to those given."""
    centre = np.zeros(x.shape[1]) if around is None else around
    w = centre.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - centre)
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """Classifiers in chain order; each sees its subject's features and which of the labels before it were given."""

    names: list[str]
    lexicon: Lexicon
    usual: dict[str, np.ndarray]
    order: list[int]
    own: np.ndarray
    before: np.ndarray
    calibration: tuple[float, float]

    def decode(self, batch: pd.DataFrame) -> np.ndarray:
        """(documents, subjects) of the likeliest sets of labels, by beam search over all documents at once."""
        x = features(self.lexicon, batch, self.usual)
        base = np.einsum("dsf,sf->ds", x, self.own)
        a, c = self.calibration
        score, given = np.zeros((len(x), 1)), np.zeros((len(x), 1, len(self.names)), bool)
        for at in self.order:
            z = a * (base[:, at][:, None] + given @ self.before[at]) + c
            yes = given.copy()
            yes[:, :, at] = True
            score = np.concatenate([score - np.logaddexp(0, z), score - np.logaddexp(0, -z)], axis=1)
            given = np.concatenate([given, yes], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
            score, given = np.take_along_axis(score, top, axis=1), np.take_along_axis(given, top[:, :, None], axis=1)
        return given[:, 0]


def fit_chain(x: np.ndarray, y: np.ndarray, names: list[str], lexicon: Lexicon, usual: dict[str, np.ndarray]) -> Chain:
    """x is (documents, subjects, features), y (documents, subjects). A third of the documents calibrates, if there are 30 or more.

    Coefficients are fitted over all subjects first; every subject's own are drawn to those, so that subjects with few labels keep near them.
    """
    k, size = len(names), x.shape[2]
    order = [int(s) for s in np.argsort(-y.sum(axis=0), kind="stable")]
    part = np.arange(len(x)) % 3
    fit = part != 0 if len(x) >= 30 else np.ones(len(x), bool)
    shared = _logistic(x[fit].reshape(-1, size), y[fit].reshape(-1).astype(float))
    own, before = np.zeros((k, size)), np.zeros((k, k))
    for place, at in enumerate(order):
        seen = y[:, order[:place]].astype(float)
        w = _logistic(np.concatenate([x[fit][:, at], seen[fit]], axis=1), y[fit][:, at].astype(float), OWN_RIDGE, np.r_[shared, np.zeros(place)])
        own[at], before[at, order[:place]] = w[:size], w[size:]
    held = ~fit if (~fit).any() else fit
    z = np.stack([x[held][:, at] @ own[at] + y[held].astype(float) @ before[at] for at in range(k)], axis=1).reshape(-1)
    cal = _logistic(np.stack([z, np.ones(len(z))], axis=1), y[held].reshape(-1).astype(float), 0.1)
    return Chain(names, lexicon, usual, order, own, before, (float(max(cal[0], 0.1)), float(cal[1])))


def train(tokens: DataFrame, labels: DataFrame, subjects: DataFrame, most_labelled: int = MOST_LABELLED) -> Chain | None:
    """The model from labelled documents (at most most_labelled, the smallest hashes of doc_id) and all sentences of tokenised documents; None without any.

    The driver gets the labels, the features of labelled documents (about 2 KB each) and the terms with weights, block by block, but no texts.
    """
    names = sorted(r[0] for r in few_rows(subjects.filter("subject is not null").select("subject").distinct(), 10_000))
    at = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)]) if names else None
    if not names:
        return None
    usable = labels.withColumn("at", at[F.col("subject")]).filter("doc_id is not null and at is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("labels"))
    by_doc = checkpointed(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    labelled = checkpointed(tokens.join(F.broadcast(by_doc), "doc_id").dropDuplicates(["doc_id"]))
    told = labelled.select("doc_id", "source", "labels").toPandas().sort_values("doc_id", ignore_index=True)
    if not len(told):
        return None
    k = len(names)
    lexicon = Lexicon(_labelled_counts(labelled.drop("labels"), by_doc), k, 2, 0.5)
    for _ in range(_ROUNDS):
        new = Lexicon(_taught_counts(tokens, lexicon), k, 4, 0.55, "top.n >= 0.55 * total and top.m >= 0.4 * around")
        lexicon = new if new.blocks else lexicon
    y = np.array([np.isin(np.arange(k), s) for s in told["labels"]])
    base = (y.sum(axis=0) + 1) / (len(y) + k)
    usual = {"": base}
    for source, rows in told.groupby(told["source"].fillna("")).groups.items():
        usual[source] = (y[rows].sum(axis=0) + 20 * base) / (len(rows) + 20)
    usual[""] = base
    kind = dict(labelled.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            if len(batch):
                x = features(lexicon, batch, usual).astype(np.float32)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [r.ravel() for r in x]})

    rows = labelled.mapInPandas(run, f"doc_id {kind}, x array<float>").toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), k, -1)
    return fit_chain(x, y, names, lexicon, usual)


def subject_areas(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject), once each: the areas each document is about, none, one or several.

    Null and blank texts have none; whole texts are read. Without any usable label there are no areas. Copies of a doc_id count once.
    """
    kind = dict(docs.dtypes)["doc_id"]
    tokens = tokenised(docs)
    chain = train(tokens, labels, subjects)
    if chain is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, subject string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _parts(batches):
            if len(batch):
                doc, at = np.nonzero(chain.decode(batch))
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[doc], "subject": [chain.names[i] for i in at]})

    return tokens.mapInPandas(run, f"doc_id {kind}, subject string").distinct()
