"""Small driver-side inputs: configuration with defaults, templates, offsets, labelled paths, experiment names."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import SparkSession

LABEL = re.compile(r"[A-Za-z0-9._-]+")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text, such as a prompt template, wherever it lies."""
    return spark.read.text(path, wholetext=True).first()["value"]


def scalar(text: str):
    """A value of a settings file: JSON where it is, else null for ~ or nothing, else the text without quotes."""
    text = text.strip()
    if text in ("", "~", "null"):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text.strip("'\"")


def parse_settings(text: str) -> dict:
    """Sections of ``key: value`` lines, nested by indentation; JSON objects are read as such."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line)
        if not bare.strip():
            continue
        depth = len(bare) - len(bare.lstrip())
        key, colon, value = bare.strip().partition(":")
        if not colon:
            raise ValueError(f"no key in {line!r}")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = scalar(value)
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def with_defaults(settings: dict, defaults: dict) -> dict:
    """``defaults``, replaced and extended section by section; a null setting leaves the default."""
    out = dict(defaults)
    for key, value in settings.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = with_defaults(value, out[key])
        elif value is not None:
            out[key] = value
    return out


def flat(settings: dict, before: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in settings.items():
        out |= flat(value, f"{before}{key}.") if isinstance(value, dict) else {before + key: json.dumps(value)}
    return out


def offset(text: str | None) -> int:
    """A checkpoint's whole number; an empty or missing one is 0."""
    return int(text) if text and text.strip() else 0


def labelled_paths(specs: list[str]) -> dict[str, str]:
    """label=path, split at the first equals sign; labels are checked and differ."""
    out: dict[str, str] = {}
    for spec in specs:
        label, equals, path = spec.partition("=")
        if not equals or not path or not LABEL.fullmatch(label) or label in out:
            raise ValueError(f"not a new label=path: {spec!r}")
        out[label] = path
    return out


def short_rate(rate: float) -> str:
    """A learning rate without the exponent's leading zeros: 1e-5."""
    return re.sub(r"e([+-])0+", r"e\1", f"{rate:g}")


def experiment_name(model: str, rate: float, epochs: int, taken=()) -> str:
    """model_lr_epochs, with a number behind it if that is taken."""
    name, k = f"{model}_lr{short_rate(rate)}_e{epochs}", 1
    out = name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def now_iso() -> str:
    return datetime.now(UTC).isoformat()
