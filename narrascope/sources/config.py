"""Configuration: small files that the driver reads, and what plans take from them."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Defaults of the validation configuration.
VALIDATION_DEFAULTS = {"forward_windows": ["1M", "3M"], "basket_top_n": 10, "benchmarks": ["equal_weight_universe", "sector_equal_weight", "random_community_baseline"], "random_seed": 42, "min_points_for_claim": 3}


def scalar(text: str):
    """A plain value: true, false, null, a number, or text without its quotes."""
    text = text.strip()
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text[0] in "'\"" and text[-1] == text[0] and len(text) > 1:
        return text[1:-1]
    if text[0] == "[" and text[-1] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str):
    """Nested maps and lists of plain values by indentation: the part of YAML that the configuration files use.

    Comments, ``key: value``, ``- value``, ``- key: value`` and flow lists. Anchors, block text and flow maps are refused.
    """
    lines = []
    for raw in text.splitlines():
        body = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(i: int, depth: int):
        out = [] if lines[i][1].startswith("- ") or lines[i][1] == "-" else {}
        while i < len(lines) and lines[i][0] == depth:
            said = lines[i][1]
            if isinstance(out, list):
                if not said.startswith("-"):
                    break
                rest = said[1:].strip()
                inner = depth + len(said) - len(said[1:].lstrip())
                if not rest:
                    value, i = block(i + 1, lines[i + 1][0])
                elif ":" in rest and rest[0] not in "'\"[" and (rest.endswith(":") or ": " in rest):
                    lines[i] = (inner, rest)
                    value, i = block(i, inner)
                else:
                    value, i = scalar(rest), i + 1
                out.append(value)
                continue
            key, colon, rest = said.partition(":")
            if not colon or rest.strip()[:1] in ("&", "*", "|", ">", "{"):
                raise ValueError(f"not understood: {said}")
            if rest.strip():
                out[key.strip().strip("'\"")], i = scalar(rest), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > depth or lines[i + 1][0] == depth and lines[i + 1][1].startswith("- ")):
                out[key.strip().strip("'\"")], i = block(i + 1, lines[i + 1][0])
            else:
                out[key.strip().strip("'\"")], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def load(spark: SparkSession, path: str):
    """A configuration file from any file system that Spark reads; {} where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    return parse(spark.read.text(path, wholetext=True).first()[0])


def validation_settings(found: dict) -> dict:
    """Settings with the defaults for what is not set."""
    return {**VALIDATION_DEFAULTS, **{k: v for k, v in (found.get("validation", found) or {}).items() if v is not None}}


def window_months(window: str) -> int:
    """'3M' is 3."""
    if not window.upper().endswith("M") or not window[:-1].isdigit():
        raise ValueError(f"not a window: {window}")
    return int(window[:-1])


def model_for(task: str, routes: dict, environment: dict[str, str]) -> str | None:
    """The model of a task: its own route, the default, the environment's, none."""
    return routes.get(task) or routes.get("default") or environment.get("LLM_MODEL") or None
