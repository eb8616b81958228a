"""Settings of builds and searches, read from JSON and checked at once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

MAX_N = 10
ATTR_TYPES = ("col8", "col32")


def corpus_name(path: str) -> str:
    """The file's name without its last extension."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def attr_column(name: str) -> str:
    """Attributes such as ``doc.file`` become columns without a dot."""
    return name.replace(".", "_")


@dataclass
class BuildConf:
    input_path: str
    source_type: str
    out_dir: str = ""
    min_freq: int = 0
    attrs: dict[str, str] = field(default_factory=dict)
    filter_args: list = field(default_factory=list)
    stop: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    ignore_structs: list[str] = field(default_factory=list)
    match_prefix: list[str] = field(default_factory=list)
    tag_column: int = 0
    window_filter: str = ""
    window_filter_lib: str = ""
    strict_structs: bool = False
    encoding: str = "utf-8"

    #: JSON keys; ``tmpDir``, ``procChunkSize`` and ``logProgressEachNth`` are accepted without effect.
    KEYS = {
        "inputFilePath": "input_path",
        "sourceType": "source_type",
        "outDirectory": "out_dir",
        "minNgramFreq": "min_freq",
        "args": "attrs",
        "filterArgs": "filter_args",
        "ngramStopStrings": "stop",
        "ngramIgnoreStrings": "ignore",
        "ngramIgnoreStructs": "ignore_structs",
        "ngramMatchPrefix": "match_prefix",
        "tagAttrIdx": "tag_column",
        "useStrictStructParser": "strict_structs",
        "encoding": "encoding",
    }
    IDLE = ("tmpDir", "procChunkSize", "logProgressEachNth")

    def __post_init__(self) -> None:
        if self.source_type not in ("plain", "vertical"):
            raise ValueError(f"unknown source type {self.source_type!r}")
        bad = {k: v for k, v in self.attrs.items() if v not in ATTR_TYPES}
        if bad:
            raise ValueError(f"unknown attribute types: {bad}")
        if self.min_freq < 0:
            raise ValueError("the least frequency is negative")
        self.out_dir = self.out_dir or os.path.dirname(self.input_path) or "."

    @property
    def corpus(self) -> str:
        return corpus_name(self.input_path)

    def index_dir(self) -> str:
        return f"{self.out_dir.rstrip('/')}/{self.corpus}"

    def export_path(self, n: int) -> str:
        return f"{self.out_dir.rstrip('/')}/{self.corpus}_{n}-grams.txt"

    @classmethod
    def load(cls, path: str) -> BuildConf:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, raw: dict[str, Any]) -> BuildConf:
        made: dict[str, Any] = {}
        for key, value in raw.items():
            if key == "ngramFilter":
                made["window_filter"] = (value or {}).get("fn", "")
                made["window_filter_lib"] = (value or {}).get("lib", "")
            elif key in cls.KEYS:
                made[cls.KEYS[key]] = value if value is not None else []
            elif key not in cls.IDLE:
                raise ValueError(f"unknown setting {key!r}")
        missing = [k for k in ("inputFilePath", "sourceType") if k not in raw]
        if missing:
            raise ValueError(f"missing settings: {missing}")
        return cls(**made)


@dataclass
class SearchConf:
    data_path: str
    port: int = 8090
    address: str = "127.0.0.1"

    @classmethod
    def load(cls, path: str) -> SearchConf:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if "dataPath" not in raw:
            raise ValueError("missing setting: dataPath")
        return cls(raw["dataPath"], int(raw.get("serverPort", 8090)), raw.get("serverAddress", "127.0.0.1"))


def check_n(n: int) -> int:
    if not 1 <= n <= MAX_N:
        raise ValueError(f"n must be between 1 and {MAX_N}, not {n}")
    return n
