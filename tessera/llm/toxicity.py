"""Toxicity by a weighted grammar of finite-state transducers.

Small transducers map words to classes: insults (learned from labels, as words and word beginnings) and threats, targets,
negation, reported speech (fixed lists). ``compose`` joins them into one machine that reads a clause word by word and
adds up the weights of what it matched: a bare insult, an insult aimed at someone, a negated or a reported one, a threat.
A document's clauses are pooled and calibrated to a probability on the training rows.

A clause without an insult or a threat has weight 0 in this grammar, so an Aho-Corasick scan over the whole text finds the
clauses worth reading, and the machine reads only those.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import trimmed, written
from tessera.llm.supervised import TRAIN_ROWS, remainder, score_all, sigmoid, training_rows

# Closed word classes in English, German, French and Spanish.
THREATS = "kill murder stab shoot strangle töten umbringen erschießen tuer étrangler poignarder matar asesinar apuñalar".split()
TARGETS = "you your yourself u he she they them him her dich du ihr euch dein tu toi vous ton votre usted ustedes vosotros él ella".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said says say called quoted wrote claims sagte sagt schrieb rief dit écrit disait dijo dice escribió".split()
#: Words over which negation, report and target still act on an insult.
REACH = 3
#: Insults believed before any label is seen; the labels decide their weights. Fixed values.
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown".split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_BREAK = re.compile(r"[.!?;\n]")
_BEGINNINGS = range(4, 9)
PATTERNS = ("insult", "aimed", "negated", "reported", "threat", "aimed_threat")


def _neighbourhoods(text: str, y: int) -> set[tuple[str, int, int]]:
    """(word, label, hash of the words beside it) of a text, each once."""
    words = _WORD.findall(text.lower())
    return {(w, y, zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"))) for a, w, b in zip(["", *words], words, [*words[1:], ""], strict=False)}


def occurrences(sample: DataFrame) -> DataFrame:
    """(w, pos, neg) for words and, with a star, for word beginnings: occurrences in toxic and other texts of the sample.

    Occurrences count by distinct neighbours, so copies of a document count once.
    """

    def run(batches):
        for b in trimmed(batches):
            found = set().union(*(_neighbourhoods(t, y) for t, y in zip(b["text"], b["y"], strict=True)))
            yield pd.DataFrame(list(found), columns=["w", "y", "c"])

    words = sample.select("text", "y").mapInPandas(run, "w string, y int, c bigint").distinct().groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    starts = F.array(F.col("w"), *[F.when(F.length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in _BEGINNINGS])
    long_enough = words.select(F.explode(F.array_compact(starts)).alias("x"), "pos", "neg")
    return long_enough.groupBy(F.col("x").alias("w")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def induce(sample: DataFrame, doubt: float = 0.01) -> dict[str, float]:
    """Insults from labelled texts: a word, or ``beginning*``, with its weight.

    An entry must be commoner in toxic texts beyond doubt, for all candidates together (Chernoff bound); the shortest
    beginning that has the evidence of the longer ones stands for them. Only entries that are nearly always toxic reach the
    driver.
    """
    counted = written(occurrences(sample), "toxic-words")
    whole = counted.agg(F.count("*").alias("n"), F.sum(F.when(~F.col("w").endswith("*"), F.col("pos"))).alias("pos"), F.sum(F.when(~F.col("w").endswith("*"), F.col("neg"))).alias("neg")).first()
    if not whole.pos or not whole.neg:
        return {}
    base, need = whole.pos / (whole.pos + whole.neg), math.log(max(whole.n, 1) / doubt)
    rows = {r.w: (r.pos, r.neg) for r in counted.where("pos >= 5 and pos - 0.5 >= 0.9 * (pos + neg)").collect()}
    out: dict[str, float] = {}
    for w, (pos, neg) in sorted(rows.items(), key=lambda x: (len(x[0].rstrip("*")), x[0])):
        n, share = pos + neg, (pos - 0.5) / (pos + neg)
        evidence = n * (share * math.log(share / base) + (1 - share) * math.log(max(1 - share, 1e-12) / (1 - base))) if share > base else 0.0
        stem = w.rstrip("*")
        if evidence <= need or any(stem[:k] + "*" in out for k in range(1, len(stem) + 1)):
            continue
        # Where something longer has all its occurrences, that is meant: a word, say, and not all that begins like it.
        same = [x for x, (p, q) in rows.items() if x.startswith(stem) and p == pos and q == neg]
        meant = max(same, key=lambda x: (len(x.rstrip("*")), not x.endswith("*")))
        out[meant] = math.log((pos + 0.5) / (neg + 0.5))
    return out


@dataclass
class Transducer:
    """States are integers, 0 the start. ``arcs[state][symbol] = (next state, emitted classes)``; other symbols loop to ``rest``."""

    arcs: dict = field(default_factory=lambda: defaultdict(dict))
    rest: dict = field(default_factory=dict)


def window(mark: str, reach: int = REACH) -> Transducer:
    """After ``mark`` the next ``reach`` symbols carry it: state k means k symbols are still within reach."""
    t = Transducer()
    for k in range(reach + 1):
        t.arcs[k][mark] = (reach, ())
        t.rest[k] = (max(0, k - 1), (mark,) if k else ())
    return t


def compose() -> dict:
    """(states of the target, negation and report windows) x class of a word -> (next states, pattern matched)."""
    machines = [window(m) for m in ("target", "negation", "report")]
    table = {}
    for a in range(REACH + 1):
        for b in range(REACH + 1):
            for c in range(REACH + 1):
                for symbol in ("insult", "threat", "target", "negation", "report", "other"):
                    moved, marks = [], set()
                    for m, state in zip(machines, (a, b, c), strict=True):
                        to, out = m.arcs[state].get(symbol, m.rest[state])
                        moved.append(to)
                        marks.update(out)
                    pattern = None
                    if symbol == "insult":
                        pattern = "reported" if "report" in marks else "negated" if "negation" in marks else "aimed" if "target" in marks else "insult"
                    elif symbol == "threat" and "negation" not in marks and "report" not in marks:
                        pattern = "aimed_threat" if "target" in marks else "threat"
                    table[(a, b, c), symbol] = (tuple(moved), pattern)
    return table


MACHINE = compose()
_CLASS = {w: k for k, words in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}


class Grammar:
    """Scores texts: ``matches`` gives what each pattern matched, ``score`` the calibrated probability."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray | None = None):
        self.insults = insults
        self.weights = np.array([-3.0, 2.5, 1.0]) if weights is None else weights
        self._scan = None

    def __getstate__(self):
        return {"insults": self.insults, "weights": self.weights, "_scan": None}

    def scan(self):
        if self._scan is None:
            self._scan = ahocorasick.Automaton()
            for w in {*(w.rstrip("*") for w in self.insults), *THREATS}:
                self._scan.add_word(w, len(w))
            self._scan.make_automaton()
        return self._scan

    def weight(self, word: str) -> float | None:
        if word in self.insults:
            return self.insults[word]
        for n in range(len(word), 0, -1):
            if (x := self.insults.get(word[:n] + "*")) is not None:
                return x
        return None

    def clause(self, words: list[str]) -> dict[str, float]:
        """Weight matched by each pattern in one clause."""
        state, out = (0, 0, 0), {}
        for w in words:
            x = self.weight(w)
            symbol = "insult" if x is not None else _CLASS.get(w, "other")
            state, pattern = MACHINE[state, symbol]
            if pattern:
                out[pattern] = out.get(pattern, 0.0) + (x if x is not None else 2.0)
        return out

    def matches(self, text: str) -> dict[str, float]:
        low, total, done = text.lower(), {}, -1
        for end, n in self.scan().iter(low):
            start = end - n + 1
            if start < done or (start and (low[start - 1].isalpha())):
                continue
            # No further back than the clause before, so a long text without breaks is read once.
            begin = max(done, 0)
            cut = max(begin, max(low.rfind(c, begin, start) for c in ".!?;\n") + 1)
            stop = _BREAK.search(low, end)
            done = stop.start() if stop else len(low)
            for k, v in self.clause(_WORD.findall(low, cut, done)).items():
                total[k] = total.get(k, 0.0) + v
        return total

    def pooled(self, texts: list[str]) -> np.ndarray:
        """(1, log weight of insults and threats that stand, log weight of negated and reported ones) by text."""
        rows = []
        for t in texts:
            m = self.matches(t)
            held = sum(m.get(k, 0.0) for k in ("insult", "aimed", "threat", "aimed_threat")) + 0.5 * m.get("aimed", 0.0) + m.get("aimed_threat", 0.0)
            rows.append((1.0, math.log1p(held), math.log1p(sum(m.get(k, 0.0) for k in ("negated", "reported")))))
        return np.array(rows).reshape(len(texts), 3)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 100) -> Grammar:
        """Ridge-penalised logistic regression of the labels on pooled matches, towards the starting weights.

        Newton steps, halved until the penalised likelihood doesn't fall.
        """
        if not len(y):
            return self
        w0 = w = self.weights

        def loss(w):
            z = x @ w
            return float(np.sum(np.logaddexp(0, z) - y * z) + 0.25 * np.sum((w - w0) ** 2))

        now = loss(w)
        for _ in range(steps):
            p = sigmoid(x @ w)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - p) - 0.5 * (w - w0))
            while (after := loss(w + step)) > now and np.abs(step).max() > 1e-9:
                step = step / 2
            if now - after < 1e-9:
                break
            w, now = w + step, after
        self.weights = w
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.pooled(texts) @ self.weights)


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Grammar:
    """Learns insults and calibration from at most ``rows`` labelled documents whose crc32(doc_id) mod 4 is not 2.

    The sample is a small table; words are counted and matched by the executors, and the driver gets figures.
    """
    sample = written(training_rows(docs, labels, "toxic", lambda i: remainder(i, 4) != 2, rows=rows), "toxic-sample")
    grammar = Grammar({w: 3.0 for w in SEEDS} | induce(sample))

    def pool(batches):
        for b in trimmed(batches):
            x = grammar.pooled(b["text"].tolist())
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "a": x[:, 1], "b": x[:, 2]})

    got = sample.mapInPandas(pool, "id bigint, y int, a double, b double").toPandas().sort_values(["id", "y", "a", "b"], kind="stable")
    x = np.column_stack([np.ones(len(got)), got["a"], got["b"]]).astype(float)
    return grammar.calibrate(x, got["y"].to_numpy(dtype=np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Null texts count as empty. Rows with a null id aren't held out; repeated rows get the same score. Labels other than
    0 and 1 are ignored; of several labels of a document the largest holds. Other columns of ``docs`` aren't read.
    """
    model = learn(docs, labels, rows=rows)
    return score_all(docs, model.score, lambda i: remainder(i, 4) == 2)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """``toxicity_scores`` of all documents; odd rows as stated there."""
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
