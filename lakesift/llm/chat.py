"""Chat formatting (7): transcript parsing. A hidden Markov model over speaker-marker and line features recovers who speaks each line, by Viterbi,
before the turns are rendered in the canonical form.

States are the roles, each as the first line of a turn or a further one. A line is observed as its speaker marker (a prefix such as "Human:", or the table's role
for a turn's first line; trusted but not beyond doubt) and its features: is it the first of a row, its length, a question mark at its end, a blank line before it. Transitions and emissions are
counts, smoothed, from labelled lines: a bounded sample of conversations, chosen by hash (MAX_TRAINING of them, a parameter).

Conversations are grouped once, as each is one row of the result; a Python worker sees whole conversations, and Viterbi goes through all conversations of a batch at once, line by line.

Defined cases: a null or unknown role is no marker; the model decides. A null text is an empty turn, and is dropped as such. Null turns come first; turns with equal numbers go by
role, then text. Rows that repeat are turns that repeat. A row with a null conv_id is a conversation of its own. An empty table gives an empty one. Extra columns aren't carried. A
marker inside a text begins a turn if the model agrees. Neighbouring turns of one role become one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
ALIASES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "usr", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "answer", "a", "agent"),
}
_ROLE_OF = {alias: k for k, role in enumerate(ROLES) for alias in ALIASES[role]}
_MARKER = re.compile(r"^\s*(?:[#>*\[<|]{0,4}\s*)(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\s*[\]>*|]{0,4}\s*:|\s*[\]>|]{1,3})[*\s]*", re.I)
#: Conversations to count from at most; pseudo-counts; how far a marker is trusted.
MAX_TRAINING, SMOOTH, TRUST = 2000, 0.5, 0.97
#: Upper ends of the classes of line lengths.
LENGTHS = (0, 20, 60, 120, 240, 480, 960)
N_FEATURES = (len(LENGTHS) + 1) * 8


def lines_of(roles: list[str | None], texts: list[str | None], own: bool = True) -> list[tuple[int, int, str]]:
    """(marker, feature, text) of each line; marker -1: none. own: whether the roles are seen."""
    out = []
    for role, text in zip(roles, texts):
        blank = False
        known = _ROLE_OF.get((role or "").strip().lower(), -1) if own else -1
        for k, line in enumerate((text or "").split("\n")):
            m, marker = _MARKER.match(line), known if k == 0 else -1
            if m:
                marker, line = _ROLE_OF[m[1].lower()], line[m.end() :]
            line = line.strip()
            if not line and marker < 0:
                blank = True
                continue
            feature = int(np.searchsorted(LENGTHS, len(line))) * 8 + (k == 0) * 4 + line.endswith("?") * 2 + blank
            out.append((marker, feature, line))
            blank = False
    return out


def train(labelled: list[tuple[list[str], list[str]]], smooth: float = SMOOTH) -> dict[str, np.ndarray]:
    """Log probabilities from conversations whose roles are known: first, step (state to state) and feature. States: role * 2 + (not a turn's first line)."""
    n = 2 * len(ROLES)
    first, step, feature = np.full(n, smooth), np.full((n, n), smooth), np.full((n, N_FEATURES), smooth)
    for roles, texts in labelled:
        last = -1
        for role, text in zip(roles, texts):
            if (r := _ROLE_OF.get((role or "").strip().lower(), -1)) < 0:
                continue
            for k, (_, f, _) in enumerate(lines_of([None], [text])):
                state = 2 * r + (k > 0)
                feature[state, f] += 1
                if last < 0:
                    first[state] += 1
                else:
                    step[last, state] += 1
                last = state
    first[1::2] = 1e-6  # a conversation begins with a turn's first line
    for r in range(len(ROLES)):  # a turn goes on only in its own role
        step[[k for k in range(n) if k // 2 != r], 2 * r + 1] = 1e-6
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return {"first": log(first), "step": log(step), "feature": log(feature)}


def emissions(model: dict, markers: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Log probability of each line in each state. Without a marker a turn's first line is as likely as any: markers may have been lost."""
    n = 2 * len(ROLES)
    out = model["feature"][:, features].T.copy()
    seen = markers >= 0
    marked = np.full((len(ROLES), n), np.log((1 - TRUST) / (n - 1)))
    for r in range(len(ROLES)):
        marked[r, 2 * r] = np.log(TRUST)
    out[seen] += marked[markers[seen]] * 4  # a marker weighs more than a line's looks
    return out


def viterbi(model: dict, emitted: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The likeliest states of all sequences at once; sequence i has rows starts[i]:starts[i + 1]. Ties go to the lower state."""
    length = np.diff(starts)
    by = np.argsort(-length, kind="stable")
    live, states = by[length[by] > 0], np.zeros(len(emitted), np.int64)
    if not len(live):
        return states
    back = np.zeros((len(emitted), 2 * len(ROLES)), np.int8)
    score = np.zeros((len(length), 2 * len(ROLES)))
    score[live] = model["first"] + emitted[starts[live]]
    for k in range(1, int(length.max())):
        live = live[: int(np.searchsorted(-length[live], -k, "left"))]
        at = starts[live] + k
        moved = score[live][:, :, None] + model["step"][None]
        back[at] = moved.argmax(1)
        score[live] = moved.max(1) + emitted[at]
    full = by[length[by] > 0]
    now = np.zeros(len(length), np.int64)
    now[full] = score[full].argmax(1)
    states[starts[full] + length[full] - 1] = now[full]
    for k in range(int(length.max()) - 1, 0, -1):
        on = full[length[full] > k]
        now[on] = back[starts[on] + k, now[on]]
        states[starts[on] + k - 1] = now[on]
    return states


def turns(states: np.ndarray, lines: list[str]) -> list[tuple[str, str]]:
    """(role, text): neighbouring lines of one role are one turn; empty turns go."""
    out: list[list] = []
    for s, line in zip(states // 2, lines):
        if out and out[-1][0] == s:
            out[-1][1].append(line)
        else:
            out.append([s, [line]])
    texts = [(ROLES[r], "\n".join(x for x in parts if x)) for r, parts in out]
    return [(r, t) for r, t in texts if t]


def render(found: list[tuple[str, str]]) -> str:
    """Canonical form. The marks in a text are broken up, so that no text can end its turn."""
    safe = lambda t: t.replace("<|", "< |")
    return "".join(f"<|{r}|>\n{safe(t)}<|end|>\n" for r, t in found)


def fit(conversations: DataFrame, max_training: int = MAX_TRAINING) -> dict[str, np.ndarray]:
    """A model from at most max_training conversations."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    some = conversations.select(F.col("conv_id").alias("c")).filter("c is not null").distinct().orderBy(F.xxhash64("c"), "c").limit(max_training)
    own = conversations.join(F.broadcast(some), F.col("conv_id") == F.col("c"))
    return train([([t.role for t in r.turns], [t.text for t in r.turns]) for r in grouped(own).select("turns").toLocalIterator()])


def grouped(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order. Rows without a conv_id aren't gathered."""
    turn = F.struct("turn", "role", "text")
    known = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return known.unionByName(conversations.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns")))


def format_chats(conversations: DataFrame, model: dict[str, np.ndarray] | None = None, own: bool = True) -> DataFrame:
    """(conv_id, n_lines, n_turns, roles, chat) of conversations (conv_id, turn, role, text). own: whether the roles are markers."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    model = fit(conversations) if model is None else model
    shared = conversations.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                all_lines = [lines_of(r, t, own) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist())]
                starts = np.r_[0, np.cumsum([len(x) for x in all_lines])].astype(np.int64)
                flat = [x for lines in all_lines for x in lines]
                markers, features = np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat], np.int64)
                states = viterbi(shared.value, emissions(shared.value, markers, features), starts)
                found = [turns(states[a:b], [x[2] for x in flat[a:b]]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), pa.array(np.diff(starts)), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(r for r, _ in f) for f in found], pa.string()), pa.array([render(f) for f in found], pa.string())],
                    ["conv_id", "n_lines", "n_turns", "roles", "chat"],
                )

    kind = conversations.schema["conv_id"].dataType.simpleString()
    ready = grouped(conversations).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    return ready.mapInArrow(run, f"conv_id {kind}, n_lines long, n_turns long, roles string, chat string")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
