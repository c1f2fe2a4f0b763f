"""Datasets behind a gate: trust levels, a group-size threshold, human approval, a report, and a ledger of what was released."""

from __future__ import annotations

import itertools
import json
import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gatedframe.errors import QueryError
from gatedframe.model import Dataset
from gatedframe.plans.query import Query, QueryResult
from gatedframe.sources.delimited import build_dataset, load_delimited, load_delimited_table
from gatedframe.sources.parquet import from_frame, load_parquet
from gatedframe.sources.sample import sample_dataset
from gatedframe.tools.catalog import TOOLS, Tool
from gatedframe.tools.output import cap, to_json
from gatedframe.tools.schema import check_input

LEVELS = ("sealed", "aggregates", "raw")
DEFAULT_GROUP, FLOOR = 5, 2
LEDGER_ENTRIES = 200
APPROVAL_SECONDS = 120.0


@dataclass
class Block:
    """A chart (a stored query of one group column and one aggregate) or a note."""

    id: str
    kind: str
    title: str
    content: dict | str
    author: str = "agent"
    created_at: float = field(default_factory=time.time)


@dataclass
class Workspace:
    """``approve`` is asked before raw rows are released or everything is cleared; without it, or after ``APPROVAL_SECONDS``, the answer is no.

    ``on_tools_change`` is called with the tools (by name) that came and that went, whenever the state changes in a way that changes them.
    """

    spark: SparkSession
    approve: Callable[[dict], bool] | None = None
    trust: str = "aggregates"
    min_group_size: int = DEFAULT_GROUP
    datasets: dict[str, Dataset] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    filters: dict[str, list[dict]] = field(default_factory=dict)
    ledger: deque = field(default_factory=lambda: deque(maxlen=LEDGER_ENTRIES))
    totals: dict[str, int] = field(default_factory=lambda: {"characters": 0, "rows": 0, "calls": 0})
    on_tools_change: Callable[[list[str], list[str]], None] | None = None
    _shown: list[str] | None = None
    _pending: threading.Lock = field(default_factory=threading.Lock)
    _drawn: dict[str, tuple[Dataset, str, QueryResult]] = field(default_factory=dict)
    _ids: itertools.count = field(default_factory=lambda: itertools.count(1))

    def allows(self, level: str) -> bool:
        return LEVELS.index(self.trust) >= LEVELS.index(level)

    def set_trust(self, level: str) -> None:
        if level in LEVELS:
            self.trust = level
            self._tell()

    def _tell(self) -> None:
        """Compares the tools with those last told of."""
        now, before = self.available_tools(), self._shown
        self._shown = now
        came, went = [t for t in now if t not in (before or [])], [t for t in before or [] if t not in now]
        if self.on_tools_change and before is not None and (came or went):
            self.on_tools_change(came, went)

    def __post_init__(self) -> None:
        self._tell()

    def set_min_group_size(self, k: float) -> None:
        self.min_group_size = max(1, int(k))

    @property
    def k(self) -> int:
        """The threshold in force. Below raw access it is never under ``FLOOR``."""
        return self.min_group_size if self.trust == "raw" else max(FLOOR, self.min_group_size)

    def add(self, dataset: Dataset) -> Dataset:
        self.datasets[dataset.id] = dataset
        self._tell()
        return dataset

    def load_files(self, path: str, **limits: int | None) -> list[Dataset]:
        """Each delimited file of a path (a file, a folder or a pattern) as a dataset of its own. ``limits``: those of ``load_delimited``, where None lifts one."""
        return [self.add(d) for d in load_delimited(self.spark, path, self.datasets, **limits)]

    def load_table(self, path: str, name: str | None = None) -> Dataset:
        """All delimited files of a path as one dataset."""
        return self.add(load_delimited_table(self.spark, path, name, self.datasets))

    def load_file(self, path: str, **limits: int | None) -> Dataset:
        found = load_delimited(self.spark, path, self.datasets, **limits)
        if len(found) > 1:
            raise QueryError("several_files", f"The path has {len(found)} files; load_files takes them all.")
        return self.add(found[0])

    def load_sample(self) -> Dataset:
        return self.add(sample_dataset(self.spark, self.datasets))

    def load_text(self, name: str, text: str, separator: str | None = None) -> Dataset:
        return self.add(build_dataset(self.spark, name, text.encode(), self.datasets, separator))

    def load_parquet(self, path: str) -> Dataset:
        return self.add(load_parquet(self.spark, path, self.datasets))

    def load_frame(self, df: DataFrame, name: str) -> Dataset:
        return self.add(from_frame(df, name, self.datasets))

    def remove(self, dataset_id: str) -> None:
        """A dataset goes with its charts and its filter."""
        if gone := self.datasets.pop(dataset_id, None):
            gone.df.unpersist()
            gone.release()
        self.filters.pop(dataset_id, None)
        self.blocks = [b for b in self.blocks if b.kind != "chart" or b.content["dataset"] != dataset_id]
        self._forget()
        self._tell()

    def set_filter(self, dataset_id: str, where: list[dict] | None) -> None:
        if where:
            self.filters[dataset_id] = where
        else:
            self.filters.pop(dataset_id, None)
        self._tell()

    def add_block(self, kind: str, title: str, content: dict | str, author: str = "agent") -> Block:
        block = Block(f"block_{next(self._ids)}", kind, title, content, author)
        self.blocks.append(block)
        self._tell()
        return block

    def remove_block(self, block: Block) -> None:
        self.blocks.remove(block)
        self._forget()
        self._tell()

    def block(self, block_id: str) -> Block | None:
        return next((b for b in self.blocks if b.id == block_id), None)

    def clear(self) -> None:
        """Everything but the ledger."""
        for name in list(self.datasets):
            self.remove(name)
        self.blocks, self.filters = [], {}
        self._forget()
        self._tell()

    def request_approval(self, request: dict, seconds: float = APPROVAL_SECONDS) -> bool:
        """One request at a time; a second one meanwhile is denied."""
        if self.approve is None or not self._pending.acquire(blocking=False):
            return False
        try:
            answer: list[bool] = []
            asked = threading.Thread(target=lambda: answer.append(bool(self.approve(request))), daemon=True)
            asked.start()
            asked.join(seconds)
            return bool(answer and answer[0])
        finally:
            self._pending.release()

    def available_tools(self) -> list[str]:
        return [t.name for t in TOOLS.values() if t.available(self)]

    def tools(self) -> list[Tool]:
        return [t for t in TOOLS.values() if t.available(self)]

    def call(self, name: str, arguments: object = None) -> dict:
        """Checks, runs, caps and records one tool call; failures come back as ``{"error": ...}``."""
        tool, rows, summary = TOOLS.get(name), 0, name
        if tool is None:
            payload = {"error": {"code": "tool_unavailable", "message": f'There is no tool "{name}".'}}
        elif error := check_input(tool.schema, {} if arguments is None else arguments):
            payload = {"error": error}
        elif not tool.available(self):
            payload = {"error": {"code": "tool_unavailable", "message": f'"{name}" is not available in the present state of the workspace.'}}
        else:
            try:
                payload, summary, rows = tool.run(self, arguments or {})
            except QueryError as e:
                payload = {"error": {"code": e.code, "message": e.message, **e.detail}}
            except Exception:
                payload = {"error": {"code": "tool_failed", "message": f'"{name}" failed unexpectedly.'}}
        payload, characters, cut = cap(to_json(payload))
        failed = "error" in payload
        entry = {"tool": name, "risk": tool.risk if tool else "read", "characters": characters, "rowsReleased": 0 if failed else rows, "summary": f'{name}: {payload["error"]["code"]}' if failed else summary, "truncated": cut, "at": time.time()}
        self.ledger.appendleft(entry)
        for key, n in (("characters", characters), ("rows", entry["rowsReleased"]), ("calls", 1)):
            self.totals[key] += n
        return payload

    def _chart_spec(self, block: Block) -> dict:
        """A chart's query under the present filter and threshold."""
        chart = block.content
        order = [chart["orderBy"]] if chart.get("orderBy") else None
        return {"where": self.filters.get(chart["dataset"]), "groupBy": [chart["groupBy"]], "aggregate": [chart["aggregate"]], "orderBy": order, "limit": chart.get("limit"), "minGroupSize": self.k}

    def chart_query(self, block: Block) -> Query:
        return Query(self.datasets[block.content["dataset"]], self._chart_spec(block))

    def _chart(self, block_id: str) -> Block:
        block = self.block(block_id)
        if block is None or block.kind != "chart":
            raise QueryError("unknown_block", f'There is no chart "{block_id}".')
        return block

    def render_chart(self, block_id: str) -> DataFrame:
        return self.chart_query(self._chart(block_id)).frame()

    def chart_result(self, block_id: str) -> QueryResult:
        """What a chart shows. It is worked out again only if the dataset, the query, the filter or the threshold isn't what it was when the chart was last drawn."""
        block = self._chart(block_id)
        dataset, spec = self.datasets[block.content["dataset"]], json.dumps(self._chart_spec(block), sort_keys=True, default=str)
        held = self._drawn.get(block_id)
        if held is None or held[0] is not dataset or held[1] != spec:
            held = self._drawn[block_id] = (dataset, spec, self.chart_query(block).run())
        return held[2]

    def remember_chart(self, block: Block, result: QueryResult) -> None:
        """Keeps a result that was just worked out for a new chart."""
        self._drawn[block.id] = (self.datasets[block.content["dataset"]], json.dumps(self._chart_spec(block), sort_keys=True, default=str), result)

    def _forget(self) -> None:
        """Results of charts that are gone."""
        held = {b.id for b in self.blocks}
        self._drawn = {k: v for k, v in self._drawn.items() if k in held}

    def chart_points(self, block_id: str) -> list[dict]:
        """(label, value) of a chart; groups without a numeric value are left out."""
        return [{"label": r[0], "value": float(r[1])} for r in self.chart_result(block_id).rows if isinstance(r[1], (int, float)) and not isinstance(r[1], bool)]
