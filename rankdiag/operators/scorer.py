"""A candidate scorer: a small network over candidate features, a category and, by mode, image, text or task.

The weights are a driver-side dictionary of a size fixed by the feature widths and vocabularies; scoring runs in Arrow
batches on the executors, and so does training over all groups (train_rows); train and train_groups take rows that the
caller bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.base import GROUP
from .graph import _checkpoint
from .quantiles import on_groups

HIDDEN, CATEGORY = 64, 16
MODES = ("candidate_only", "metadata_only", "task_id", "pooled_pe")

Weights = dict[str, np.ndarray]


def start(inputs: int, categories: int = 1, mode: str = "candidate_only", prompts: int = 1, image: int = 0, text: int = 0, seed: int = 0) -> Weights:
    """First weights. Context modes add two parts of HIDDEN numbers: image and task, or image and text."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    r = np.random.default_rng(seed)
    dense = lambda n, m: r.uniform(-(n**-0.5), n**-0.5, (n, m))
    w = {"candidate": dense(inputs, HIDDEN), "candidate_b": np.zeros(HIDDEN), "gain": np.ones(HIDDEN), "shift": np.zeros(HIDDEN), "category": r.normal(size=(categories, CATEGORY))}
    if mode in ("task_id", "pooled_pe"):
        w |= {"image": dense(image, HIDDEN), "image_b": np.zeros(HIDDEN)}
        w |= {"prompt": r.normal(size=(prompts, HIDDEN))} if mode == "task_id" else {"text": dense(text, HIDDEN), "text_b": np.zeros(HIDDEN)}
    width = HIDDEN + CATEGORY + (2 * HIDDEN if "image" in w else 0)
    return w | {"head": dense(width, HIDDEN), "head_b": np.zeros(HIDDEN), "out": dense(HIDDEN, 1)[:, 0], "out_b": np.zeros(1)}


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x * Phi(x) and its derivative; erf to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    phi = np.where(x >= 0, 1 - tail / 2, tail / 2)
    return x * phi, phi + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def _forward(w: Weights, x: np.ndarray, category: np.ndarray, prompt=None, image=None, text=None) -> dict:
    z = x @ w["candidate"] + w["candidate_b"]
    sd = np.sqrt(z.var(1, keepdims=True) + 1e-5)
    n = (z - z.mean(1, keepdims=True)) / sd
    a, da = _gelu(n * w["gain"] + w["shift"])
    parts = [a, w["category"][category]]
    if "image" in w:
        parts.append(image @ w["image"] + w["image_b"])
        parts.append(w["prompt"][prompt] if "prompt" in w else text @ w["text"] + w["text_b"])
    h = np.concatenate(parts, 1)
    g, dg = _gelu(h @ w["head"] + w["head_b"])
    return {"sd": sd, "n": n, "da": da, "h": h, "g": g, "dg": dg, "logit": g @ w["out"] + w["out_b"]}


def forward(x: np.ndarray, w: Weights, category: np.ndarray | None = None, **context) -> np.ndarray:
    """Logits of rows."""
    return _forward(w, x, np.zeros(len(x), int) if category is None else category, **context)["logit"]


def gradients(x: np.ndarray, y: np.ndarray, w: Weights, category: np.ndarray | None = None, share: np.ndarray | None = None, **context) -> tuple[float, Weights]:
    """Mean binary cross-entropy of logits and its gradients; with `share`, the rows' weights, sums by those."""
    category = np.zeros(len(x), int) if category is None else category
    f = _forward(w, x, category, **context)
    logit = f["logit"]
    share = np.full(len(y), 1 / len(y)) if share is None else share
    loss = float(share @ (np.logaddexp(0, logit) - y * logit))
    d = (1 / (1 + np.exp(-logit)) - y) * share
    dh = (d[:, None] * w["out"]) * f["dg"]
    out = {"out": f["g"].T @ d, "out_b": np.array([d.sum()]), "head": f["h"].T @ dh, "head_b": dh.sum(0)}
    part = dh @ w["head"].T
    back = part[:, :HIDDEN] * f["da"]
    out |= {"gain": (back * f["n"]).sum(0), "shift": back.sum(0)}
    dn = back * w["gain"]
    dz = (dn - dn.mean(1, keepdims=True) - f["n"] * (dn * f["n"]).mean(1, keepdims=True)) / f["sd"]
    out |= {"candidate": x.T @ dz, "candidate_b": dz.sum(0), "category": np.zeros_like(w["category"])}
    np.add.at(out["category"], category, part[:, HIDDEN : HIDDEN + CATEGORY])
    if "image" in w:
        at = HIDDEN + CATEGORY
        first, second = part[:, at : at + HIDDEN], part[:, at + HIDDEN :]
        out |= {"image": context["image"].T @ first, "image_b": first.sum(0)}
        if "prompt" in w:
            out["prompt"] = np.zeros_like(w["prompt"])
            np.add.at(out["prompt"], context["prompt"], second)
        else:
            out |= {"text": context["text"].T @ second, "text_b": second.sum(0)}
    return loss, out


class _AdamW:
    """AdamW steps over a dictionary of weights."""

    def __init__(self, w: Weights, rate: float, decay: float):
        self.w, self.rate, self.decay, self.i = w, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))

    def step(self, g: Weights) -> None:
        self.i += 1
        for k, w in self.w.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            self.w[k] = w * (1 - self.rate * self.decay) - self.rate * (self.m[k] / (1 - 0.9**self.i)) / (np.sqrt(self.v[k] / (1 - 0.999**self.i)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 3e-4, decay: float = 1e-4, seed: int = 0, weights: Weights | None = None, **inputs) -> tuple[Weights, list[float]]:
    """AdamW on labeled rows (y: 1 for a positive), all in each step; the caller bounds the sample that it brings here."""
    w = {k: a.copy() for k, a in (weights or start(x.shape[1], seed=seed)).items()}
    by, losses = _AdamW(w, rate, decay), []
    for _ in range(steps):
        loss, g = gradients(x, y, w, **inputs)
        losses.append(loss)
        by.step(g)
    return w, losses


def train_groups(x: np.ndarray, label: np.ndarray, group: np.ndarray, epochs: int = 5, rate: float = 3e-4, decay: float = 1e-4, seed: int = 0, weights: Weights | None = None, **inputs) -> tuple[Weights, list[float]]:
    """As train, one step for each rankable group in a seeded order anew each epoch; the losses are epochs' means.

    label: 0 for a positive, 1 and 2 for negatives, NaN for unknown rows, which train nothing. Groups without a positive or
    without a negative train nothing either.
    """
    w = {k: a.copy() for k, a in (weights or start(x.shape[1], seed=seed)).items()}
    by, losses, rng = _AdamW(w, rate, decay), [], np.random.default_rng(seed)
    known = np.isin(label, (0, 1, 2))
    rows = [np.flatnonzero((group == g) & known) for g in np.unique(group)]
    rows = [r for r in rows if (label[r] == 0).any() and (label[r] != 0).any()]
    for _ in range(epochs):
        total = []
        for i in rng.permutation(len(rows)):
            r = rows[i]
            loss, g = gradients(x[r], (label[r] == 0).astype(float), w, **{k: v[r] for k, v in inputs.items()})
            total.append(loss)
            by.step(g)
        losses.append(float(np.mean(total)) if total else float("nan"))
    return w, losses


def _flat(g: Weights) -> np.ndarray:
    return np.concatenate([g[k].ravel() for k in sorted(g)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    at, out = 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _context(weights: Weights) -> list[str]:
    """The columns of scorer inputs that these weights look at besides candidate and category."""
    return [c for c, part in (("image", "image"), ("prompt_id", "prompt"), ("text", "text")) if part in weights]


def _arrays(b: pa.RecordBatch, wanted: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features, categories and context of a batch of scorer inputs."""
    at = dict(zip(b.schema.names, b.columns, strict=True))
    wide = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(float)
    return wide(at["candidate"]), at["category"].to_numpy(), {"prompt" if c == "prompt_id" else c: at[c].to_numpy() if c == "prompt_id" else wide(at[c]) for c in wanted}


#: Rows of gradients that the driver adds up; more tasks than that are added up in a step between.
SUMS = 64


def train_rows(inputs: DataFrame, weights: Weights, group: Sequence[str] = GROUP, epochs: int = 5, steps: int = 8, rate: float = 3e-4, decay: float = 1e-4, seed: int = 0) -> tuple[Weights, list[float]]:
    """Train on all rankable groups of scorer inputs (group..., label, candidate, category and what the weights look at).

    An epoch has `steps` steps; each takes the groups that a digest of group, seed and epoch puts there, with the mean
    over its groups of their mean loss, as train_groups does with one group a step. A row's share of that is one over the
    labeled rows of its group, so rows of a group need not meet: each task sums the gradients of its rows, and the driver holds weights and
    at most SUMS such sums. Unknown rows and groups without a positive or a negative train nothing. The losses are
    epochs' means. Sums are of doubles in the order in which tasks end, so reruns agree to rounding.
    """
    wanted, spark = _context(weights), inputs.sparkSession
    known = inputs.where(F.col("label").isin(0, 1, 2))
    size = known.groupBy(*group).agg(F.count("*").alias("_rows"), F.count_if(F.col("label") == 0).alias("_hits")).where("_hits > 0 and _hits < _rows")
    rows = on_groups(known, size, group).select("candidate", "category", *wanted, (F.col("label") == 0).cast("double").alias("_y"), (1 / F.col("_rows")).alias("_share"), F.xxhash64(*group).alias("_h"))
    rows = _checkpoint(rows)
    many = rows.rdd.getNumPartitions() > SUMS
    w = {k: a.copy() for k, a in weights.items()}
    by, losses, size_ = _AdamW(w, rate, decay), [], sum(a.size for a in weights.values()) + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(b.num_rows, size_).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["g"])

    for epoch in range(epochs):
        told = []
        for step in range(steps):
            held = spark.sparkContext.broadcast(w)

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size_)
                for b in batches:
                    for k in range(0, b.num_rows, 4096):
                        part = b.slice(k, 4096)
                        x, category, context = _arrays(part, wanted)
                        y, share = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("_y", "_share"))
                        loss, g = gradients(x, y, held.value, category, share, **context)
                        total += np.concatenate([_flat(g), [loss, share.sum()]])
                if total[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["g"])

            own = rows.where(F.pmod(F.xxhash64("_h", F.lit(seed), F.lit(epoch)), F.lit(steps)) == step)
            parts = own.mapInArrow(run, "g array<double>")
            if many:
                parts = parts.repartition(SUMS).mapInArrow(summed, "g array<double>")
            sums = [np.asarray(r["g"]) for r in parts.collect()]
            held.destroy()
            total = np.sum(sums, 0) if sums else np.zeros(size_)
            if total[-1]:
                by.step(_shaped(total[:-2] / total[-1], w))
                told.append(total[-2] / total[-1])
        losses.append(float(np.mean(told)) if told else float("nan"))
    return w, losses


def score_inputs(inputs: DataFrame, weights: Weights, *key: str) -> DataFrame:
    """(key..., logit) of every row of scorer inputs (candidate, category, prompt_id, image, text), unknown labels included.

    Which inputs count is what the weights hold: of context modes the image, and the prompt or the text.
    """
    wanted = _context(weights)
    slim = inputs.select(*key, "candidate", "category", *wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, category, context = _arrays(b, wanted)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(key))], pa.array(forward(x, weights, category, **context))], [*key, "logit"])

    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", logit double")


def score_vectors(vectors: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(vec_id, logit) for every row, unknown labels included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1)
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forward(m, weights or start(m.shape[1])))], ["vec_id", "logit"])

    return vectors.mapInArrow(run, "vec_id long, logit double")
