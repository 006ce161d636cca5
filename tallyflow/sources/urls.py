"""Open a source by URL: ``type:path?name=value,name=value``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyflow.schema import UPDATE_SCHEMA
from tallyflow.sources.generators import gen_uniform
from tallyflow.sources.logs import read_web_log, read_wifi_log, stream_web_log
from tallyflow.sources.stored import DATA, read_stream
from tallyflow.streaming.feeds import stream_files

OPEN_MODES = ("truncate", "append")
TEXT_FORMATS = ("csvtab", "csvrel")


@dataclass(frozen=True)
class SourceUrl:
    type: str
    path: str
    options: dict[str, str]
    mode: str = "truncate"
    format: str = "csvtab"


def _is_name(word: str) -> bool:
    return word.isascii() and word.isidentifier()


def parse_url(url: str) -> SourceUrl:
    """Splits at the first ``:``, then at the first ``?``, then options at ``,`` and ``=``."""
    kind, colon, rest = url.partition(":")
    path, mark, tail = rest.partition("?")
    pairs = [option.partition("=") for option in tail.split(",")] if mark else []
    if not colon or not _is_name(kind):
        raise ValueError(f"{url!r} does not start with a source type and a colon")
    if any(not _is_name(name) or not value for name, _, value in pairs):
        raise ValueError(f"write the options of {url!r} as name=value, with commas between them")
    options = {name: value for name, _, value in pairs}
    mode, fmt = options.get("open_mode", OPEN_MODES[0]), options.get("format", TEXT_FORMATS[0])
    if mode not in OPEN_MODES:
        raise ValueError(f"open_mode is one of {OPEN_MODES}, not {mode!r}")
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"format is one of {TEXT_FORMATS}, not {fmt!r}")
    return SourceUrl(kind, path, options, mode, fmt)


def _number(options: dict[str, str], name: str) -> int:
    if name not in options:
        raise ValueError(f"add {name}=<number> to the options of the url")
    try:
        return int(options[name])
    except ValueError:
        raise ValueError(f"{name} must be a whole number, not {options[name]!r}") from None


def open_source(spark: SparkSession, url: str, streaming: bool = False) -> DataFrame:
    """The update stream behind a URL: ``wcup``, ``crawdad``, ``stream`` (also ``hdf5``) or ``gen``.

    With ``streaming``, ``wcup`` and ``stream`` give a streaming DataFrame that takes records as they come;
    options ``max_records`` and ``max_files`` bound a micro-batch.
    """
    u = parse_url(url)
    if streaming:
        if u.type == "wcup":
            return stream_web_log(spark, u.path, _number(u.options, "max_records") if "max_records" in u.options else None)
        if u.type in ("stream", "hdf5"):
            dataset = u.options.get("dataset")
            path = f"{u.path}/{dataset}" if dataset else u.path
            return stream_files(spark, f"{path}/{DATA}", UPDATE_SCHEMA, _number(u.options, "max_files") if "max_files" in u.options else None)
        raise ValueError(f"a {u.type!r} source has no live form; wcup, stream and hdf5 have")
    if u.type == "wcup":
        return read_web_log(spark, u.path)
    if u.type == "crawdad":
        return read_wifi_log(spark, u.path)
    if u.type in ("stream", "hdf5"):
        dataset = u.options.get("dataset")
        return read_stream(spark, f"{u.path}/{dataset}" if dataset else u.path)
    if u.type == "gen":
        if u.path != "uniform":
            raise ValueError(f"no generator is called {u.path!r}; there is uniform")
        n = {o: _number(u.options, o) for o in ("maxsid", "maxhid", "maxkey", "maxts")}
        return gen_uniform(spark, n["maxsid"], n["maxhid"], n["maxkey"], n["maxts"])
    raise ValueError(f"no source is called {u.type!r}; there are wcup, crawdad, stream, hdf5 and gen")
