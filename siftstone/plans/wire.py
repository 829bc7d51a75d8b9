"""Requests and replies as JSON, for programs that ask over a pipe or socket of their own."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, history, index, origin
from .request import Filter, Page, Request, Tables, answer, totals
from .settings import Settings, counts_occurrences

VERSION = 2
#: Bytes of a request at most
MAX_REQUEST = 64 << 10


class BadRequest(ValueError):
    pass


@dataclass
class Service:
    """What commands read and change: an index and, where kept, origins, files and versions, sources and the state of work.

    moves and records of origins are kept as DataFrames: each command that changes one puts the new one in its place.
    """

    index: index.Index
    settings: Settings
    origins: DataFrame | None = None
    documents: DataFrame | None = None
    versions: DataFrame | None = None
    sources: DataFrame | None = None
    paused: bool = False
    memory: int | None = None
    wanted: tuple[str, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.index.files.sparkSession


def parse(line: str) -> tuple[str, dict[str, Any]]:
    """(command, its fields) of one line. BadRequest for what isn't a request of this version."""
    if len(line.encode()) > MAX_REQUEST:
        raise BadRequest("the request is too long")
    try:
        said = json.loads(line)
    except ValueError as e:
        raise BadRequest("the request is no JSON") from e
    if not isinstance(said, dict) or not isinstance(said.get("cmd"), str):
        raise BadRequest("the request has no command")
    if said.get("v", VERSION) != VERSION:
        raise BadRequest(f"version {said['v']} is not spoken here")
    return said.pop("cmd"), said


def _pair(x: Any) -> tuple[int, int] | None:
    return None if x is None else (int(x[0]), int(x[1]))


def request_of(said: dict[str, Any]) -> Request:
    f, p = said.get("filter") or {}, said.get("page") or {}
    many = lambda x: None if x is None else tuple(map(str, x))
    filter_ = Filter(f.get("under"), many(f.get("ext")), many(f.get("mime")), _pair(f.get("mtime")), _pair(f.get("size")), f.get("kind"))
    return Request(str(said.get("q", "")), str(said.get("mode", "name")), filter_, Page(int(p.get("offset", 0)), int(p.get("limit", 50))), bool(said.get("include_origin", False)))


def capabilities(service: Service) -> list[str]:
    s = service.settings
    mode = "freqs" if counts_occurrences(s.defaults, service.memory) else "basic"
    out = ["sources", "list-filtered", "list-largest", "mime-filter", "kind-filter", f"content-index-mode:{mode}", f"extract-cap:{s.defaults.extract_max_mb or 'auto'}"]
    if s.defaults.names_only:
        out.append("names-only")
    if s.origin.enabled and service.origins is not None:
        out += ["file_origin", "file_origin_register"]
    return out


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """A page of rows; only pages and replies of a few rows come to the driver."""
    return [json.loads(x) for x in df.toJSON(use_unicode=True).collect()]


def _query(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    request = request_of(said)
    if service.settings.defaults.names_only and request.mode in ("content", "both"):
        request = replace(request, mode="name")
    tables = Tables.of(service.index, service.origins, service.sources)
    n = totals(tables, request).first()
    return {"hits": _rows(answer(tables, request)), "total": n["total"], "next_offset": n["next_offset"]}


def _origin(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    if service.origins is None:
        return {"origin": None}
    rows = _rows(service.origins.where(F.col("path") == said["path"]).orderBy(F.desc("updated_at")).limit(1))
    return {"origin": rows[0] if rows else None}


def _register(verb: str):
    def run(service: Service, said: dict[str, Any]) -> dict[str, Any]:
        if service.origins is None:
            return {}
        spark, now = service.spark, int(said["now"])
        if verb == "move":
            moves = spark.createDataFrame([(said["src"], said["dst"], said.get("app"))], "src string, path string, app string")
            service.origins = origin.move(service.origins, moves, now)
        else:
            event = spark.createDataFrame([(verb, said["dst"], said.get("src"), said.get("app"), None, None)], "verb string, path string, src string, app string, domain string, at bigint")
            sources = service.sources if service.sources is not None else spark.createDataFrame([], "prefix string, kind string, id string, name string")
            new = origin.register(event, sources, now).select(*service.origins.columns)
            service.origins = service.origins.join(new.select("path"), "path", "left_anti").unionByName(new)
        return {}

    return run


def _versions(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    if service.versions is None or service.documents is None:
        return {"versions": []}
    own = service.documents.where(F.col("path") == said["path"]).select(F.col("id").alias("file_id"), "mtime_s", "mtime_ns", "size")
    mine = service.versions.join(own.select("file_id"), "file_id", "left_semi")
    out = history.earlier(mine, own).orderBy(F.desc("saved_at"), F.desc("id"))
    return {"versions": _rows(out.select("id", "saved_at", "size", "reason"))}


def _forget_versions(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    if service.versions is not None and service.documents is not None:
        gone = service.documents.where(F.col("path") == said["path"]).select("id") if "path" in said else service.documents.select("id")
        service.documents, service.versions = history.forget(service.documents, service.versions, gone)
    return {}


def _status(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    n = service.index.stats.select("kind", "n").collect()
    return {"paused": service.paused, "wanted": list(service.wanted), "documents": {r["kind"]: r["n"] for r in n}, "capabilities": capabilities(service)}


def _sources(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    return {"sources": [] if service.sources is None else _rows(service.sources.orderBy("prefix"))}


def _set(**values):
    def run(service: Service, said: dict[str, Any]) -> dict[str, Any]:
        for k, v in values.items():
            setattr(service, k, v)
        return {}

    return run


def _want(what: str):
    def run(service: Service, said: dict[str, Any]) -> dict[str, Any]:
        service.wanted += (f"{what}:{said['path']}" if "path" in said else what,)
        return {}

    return run


def _clear_origin(service: Service, said: dict[str, Any]) -> dict[str, Any]:
    if service.origins is not None:
        service.origins = origin.forget_all(service.origins)
    return {}


COMMANDS = {
    "query": _query,
    "origin": _origin,
    "register_copy": _register("copy"),
    "register_move": _register("move"),
    "register_created": _register("created"),
    "register_derived": _register("derived"),
    "status": _status,
    "pause": _set(paused=True),
    "resume": _set(paused=False),
    "rebuild": _want("rebuild"),
    "reindex": _want("reindex"),
    "sources": _sources,
    "clear_origin": _clear_origin,
    "versions": _versions,
    "save_version": _want("save_version"),
    "forget_versions": _forget_versions,
    "clear_history": lambda service, said: _forget_versions(service, {}),
}


def reply(service: Service, line: str) -> str:
    """The reply to one line, as one line. What is wrong with a request is said in it; nothing is raised for it."""
    try:
        command, said = parse(line)
        if command not in COMMANDS:
            raise BadRequest(f"there is no command {command}")
        out = {"v": VERSION, "ok": True, **COMMANDS[command](service, said)}
    except (BadRequest, KeyError, TypeError, ValueError, IndexError) as e:
        out = {"v": VERSION, "ok": False, "error": f"{e!s}" if isinstance(e, BadRequest) else f"bad request: {e!r}"}
    return json.dumps(out, ensure_ascii=False)


def count(service: Service) -> int:
    return catalogue.count(service.index.files).first()["n"]
