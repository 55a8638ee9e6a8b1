"""The agent loop over a stream of events: a state machine for each trajectory, as `operators.agent_loop.fold`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajmill.operators.agent_loop import COLUMNS, GENERATING, MAX_STEPS, PENDING, TERMINATED, TOO_MANY_ERRORS, TOOLS, USER, USER_STOP, Caps

_STATE = "state string, termination string, events bigint, assistant_turns bigint, user_turns bigint, errors bigint, response_length bigint, trained_tokens bigint"

_EVENT = ("kind", "calls", "stop", "tokens", "errors")


def with_state_store(spark) -> None:  # noqa: ANN001
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def after(x: dict, event: Row, caps: Caps) -> dict:
    """The state after one more event."""
    x = {**x, "events": x["events"] + 1}
    ended = lambda why: {**x, "state": TERMINATED, "termination": why}
    tokens, state = event.tokens or 0, x["state"]
    if event.kind == "assistant" and state in (PENDING, GENERATING):
        x |= {"assistant_turns": x["assistant_turns"] + 1, "response_length": x["response_length"] + tokens, "trained_tokens": x["trained_tokens"] + tokens}
        if x["response_length"] >= caps.response or x["assistant_turns"] >= caps.assistant_turns:
            return ended(MAX_STEPS)
        return {**x, "state": TOOLS if event.calls else USER}
    if (event.kind, state) not in (("tool", TOOLS), ("user", USER)):
        return ended(MAX_STEPS)
    if event.kind == "user" and event.stop:
        return ended(USER_STOP)
    if event.kind == "tool":
        x["errors"] += event.errors or 0
    if x["response_length"] + tokens >= caps.response:
        return ended(MAX_STEPS)
    x["response_length"] += tokens
    if event.kind == "tool":
        return ended(TOO_MANY_ERRORS) if x["errors"] >= caps.errors else {**x, "state": GENERATING}
    x["user_turns"] += 1
    return ended(MAX_STEPS) if x["user_turns"] >= caps.user_turns else {**x, "state": GENERATING}


class Loop(StatefulProcessor):
    """State: where the trajectory is, and events that came before their turn, by number (numbers run from 0)."""

    def __init__(self, key: str, order: str, caps: Caps):
        self.key, self.order, self.caps = key, order, caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", f"{_STATE}, next bigint")
        self.early = handle.getMapState("early", "n bigint", "kind string, calls boolean, stop boolean, tokens bigint, errors bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self.at.get()
        x, following = (dict(zip(COLUMNS, known[:-1], strict=True)), known[-1]) if known else ({**dict.fromkeys(COLUMNS, 0), "state": PENDING, "termination": MAX_STEPS}, 0)
        came = {r[self.order]: Row(*_EVENT)(*(r[c] for c in _EVENT)) for r in rows}
        while x["state"] != TERMINATED:
            if following in came:
                event = came.pop(following)
            elif self.early.exists() and self.early.containsKey((following,)):
                event = Row(*_EVENT)(*self.early.getValue((following,)))
                self.early.removeKey((following,))
            else:
                break
            x, following = after(x, event, self.caps), following + 1
        if x["state"] == TERMINATED:
            self.early.clear()  # nothing that comes later counts
        else:
            for n, e in came.items():
                if n > following:
                    self.early.updateValue((n,), tuple(e))
        self.at.update((*(x[c] for c in COLUMNS), following))
        yield Row(**{self.key: key[0], **x})

    def close(self) -> None:
        pass


def fold(events: DataFrame, key: str, order: str, caps: Caps = Caps()) -> DataFrame:
    """A row for each trajectory that a batch touches, as it is then: key and COLUMNS; the latest has the most events. events: as the
    batch form's, with `order` numbering a trajectory's events from 0; they may come in any order, in any batch."""
    with_state_store(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = events.select(key, order, *_EVENT)
    return rows.groupBy(key).transformWithState(Loop(key, order, caps), f"{key} {kind}, {_STATE}", "Update", "None")
