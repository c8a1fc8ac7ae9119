"""Structured Streaming detector: keyed state for runs, debounce, speech gate and second-stage verifier.

Rows of a stream may come in any micro-batch split; within a batch they are put in order of hop, and hops
that come late, at or before the last one seen, are passed over. The result does not depend on the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("hop", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("verifier_score", T.DoubleType())])
STATE = T.StructType([T.StructField("seen", T.LongType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.LongType())), T.StructField("voiced", T.ArrayType(T.BooleanType())), T.StructField("rejected", T.LongType()), T.StructField("paused", T.BooleanType())])


@dataclass(frozen=True)
class Policy:
    """threshold and run length of a trigger, hops between detections, gate window and need, verifier threshold.

    pause: after a detection nothing is looked at, and all that was heard is forgotten, until a hop says resume.
    """

    threshold: float = 0.5
    consecutive: int = 1
    debounce: int = 25
    per_name: bool = False
    reset_run: bool = False
    gate_window: int = 0
    gate_needed: int = 0
    verifier: float | None = None
    pause: bool = False


class Detector:
    """The state machine of one stream, one hop at a time."""

    def __init__(self, policy: Policy):
        self.policy, self.seen, self.rejected = policy, -1, 0
        self.runs: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.voiced: list[bool] = []
        self.paused = False

    def hop(self, hop: int, scores: list[tuple[str, float, float | None]], speech: bool = True, resume: bool = False) -> tuple[str, int, float, float | None] | None:
        """One detection at most for a hop; scores: name, score, verifier score."""
        p = self.policy
        self.seen = hop
        self.paused = self.paused and not resume
        if self.paused:
            return None
        if p.gate_window:
            self.voiced = [*self.voiced, speech][-p.gate_window :]
            if sum(self.voiced) < p.gate_needed:
                self.runs = dict.fromkeys(self.runs, 0)
                return None
        found = None
        for name, score, second in sorted(scores, key=lambda x: x[0]):
            self.runs[name] = self.runs.get(name, 0) + 1 if score == score and score >= p.threshold else 0
            timer = name if p.per_name else ""
            if found or self.runs[name] < p.consecutive or timer in self.last and hop - self.last[timer] < p.debounce:
                continue
            if p.verifier is not None and not (second is not None and second >= p.verifier):
                self.runs[name] = 0
                self.rejected += 1
                continue
            self.last[timer] = hop
            found = (name, hop, score, second)
        if found and (p.reset_run or p.pause):
            self.runs = dict.fromkeys(self.runs, 0)
        if found and p.pause:
            self.paused, self.voiced = True, []
        return found

    def state(self) -> tuple:
        names = sorted({*self.runs, *self.last})
        return (self.seen, names, [self.runs.get(n, -1) for n in names], [self.last.get(n, -1) for n in names], self.voiced, self.rejected, self.paused)

    @classmethod
    def restored(cls, policy: Policy, state: tuple) -> Detector:
        d = cls(policy)
        d.seen, names, runs, last, d.voiced, d.rejected = state[0], state[1], state[2], state[3], list(state[4]), state[5]
        d.paused = bool(state[6])
        d.runs = {n: int(r) for n, r in zip(names, runs) if r >= 0}
        d.last = {n: int(x) for n, x in zip(names, last) if x >= 0}
        return d


def detect(rows: DataFrame, policy: Policy) -> DataFrame:
    """Detections of a stream of stream_id, hop, name, score and, if used, verifier_score, speech and resume."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Detector.restored(policy, state.get) if state.exists else Detector(policy)
        out = []
        batch = pd.concat(list(frames))
        for hop, part in batch.sort_values(["hop", "name"], kind="stable").groupby("hop", sort=True):
            if hop <= d.seen:
                continue
            second = part["verifier_score"] if "verifier_score" in part else [None] * len(part)
            speech = bool(part["speech"].iloc[0]) if "speech" in part else True
            scores = [(n, float("nan") if s is None else float(s), None if v is None or v != v else float(v)) for n, s, v in zip(part["name"], part["score"], second)]
            resume = bool(part["resume"].iloc[0]) if "resume" in part else False
            if found := d.hop(int(hop), scores, speech, resume):
                out.append((key[0], *found))
        state.update(d.state())
        if out:
            yield pd.DataFrame(out, columns=OUT.names).astype({"stream_id": "int64", "hop": "int64", "score": "float64", "verifier_score": "float64"})

    return rows.groupBy("stream_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
