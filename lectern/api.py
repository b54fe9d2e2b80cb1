"""Requests as applications send them: a session, one answer shape, and an error that stays inside its request."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import build_user, is_email, session_cookie, session_user
from lectern.library import Library
from lectern.operators.providers import LanguageModel, LocalEmbedder
from lectern.operators.retrieve import Filters
from lectern.operators.study import StudyRequest, check_mode
from lectern.sources.connectors import SERVICES

#: Seconds that a session cookie lasts.
SESSION_AGE = 60 * 60 * 24 * 30


@dataclass
class Answer:
    status: int
    body: dict
    #: The session cookie to set: None leaves it, an empty one clears it.
    cookie: str | None = None


class RequestError(Exception):
    """An error with its own status."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _filters(body: dict) -> Filters:
    given = body.get("filters") or {}
    return Filters(**{k: list(given.get(k) or []) for k in asdict(Filters())})


class Api:
    """Requests over the libraries under ``root``. Whoever sends the cookie of a user is that user: there are no passwords."""

    def __init__(self, spark: SparkSession, root: str, embedder=None, model: LanguageModel | None = None):
        self.spark, self.root, self.embedder, self.model = spark, root, embedder or LocalEmbedder(), model or LanguageModel()

    def _value(self, text: str, make: Callable[[Column], Column]):
        return self.spark.range(1).select(make(F.lit(text)).alias("v")).first()["v"]

    def user(self, cookie: str | None) -> Row | None:
        """The signed-in user of a cookie, null if it is missing or malformed."""
        return self._value(cookie, session_user) if cookie else None

    def _answer(self, cookie: str | None, handle: Callable[[Library, Row], dict], otherwise: int = 400) -> Answer:
        try:
            user = self.user(cookie)
            if user is None:
                raise RequestError(401, "Not signed in")
            return Answer(200, handle(Library(self.spark, self.root, user["id"], self.embedder, self.model), user))
        except RequestError as e:
            return Answer(e.status, {"error": str(e)})
        except Exception as e:  # whatever went wrong is this request's answer
            return Answer(otherwise, {"error": str(e) or type(e).__name__})

    def login(self, email: str | None) -> Answer:
        if not email or not self._value(email, is_email):
            return Answer(400, {"error": "An e-mail address is needed."})
        user = self._value(email, build_user)
        cookie = self._value(email, lambda e: session_cookie(build_user(e)))
        return Answer(200, {"user": user.asDict()}, cookie)

    def logout(self) -> Answer:
        return Answer(200, {"ok": True}, "")

    def sources(self, cookie: str | None) -> Answer:
        return self._answer(cookie, lambda lib, _: {"documents": _rows(lib.sources()), "connectors": lib.connectors(), "capabilities": lib.capabilities(), "totals": lib.totals().first().asDict()})

    def upload(self, cookie: str | None, path: str, created_at: str) -> Answer:
        return self._answer(cookie, lambda lib, _: self._report(lib.upload(path, created_at)))

    @staticmethod
    def _report(done: tuple) -> dict:
        return {"ingested": _rows(done[0]), "failed": [dict(zip(("name", "reason"), r, strict=True)) for r in done[1].collect()]}

    def delete(self, cookie: str | None, doc_id: str) -> Answer:
        def handle(lib: Library, _: Row) -> dict:
            if not lib.delete(doc_id):
                raise RequestError(404, "No such document")
            return {"ok": True}

        return self._answer(cookie, handle)

    def _connector(self, service: str) -> dict:
        if service not in SERVICES:
            raise RequestError(404, "Unknown connector")
        return next(c for c in Library(self.spark, self.root, "").connectors() if c["id"] == service)

    def connector(self, cookie: str | None, service: str) -> Answer:
        return self._answer(cookie, lambda lib, _: {"connector": self._connector(service), "documents": _rows(lib.list_connector(service))}, 502)

    def sync(self, cookie: str | None, service: str, created_at: str, ids: list[str] | None = None) -> Answer:
        return self._answer(cookie, lambda lib, _: self._connector(service) and self._report(lib.sync(service, created_at, ids)), 502)

    def taxonomy(self, cookie: str | None) -> Answer:
        def handle(lib: Library, _: Row) -> dict:
            units, concepts, totals = lib.taxonomy()
            return {"weeks": _rows(units), "concepts": _rows(concepts), **totals.first().asDict()}

        return self._answer(cookie, handle)

    def search(self, cookie: str | None, body: dict) -> Answer:
        def handle(lib: Library, _: Row) -> dict:
            results, meta = lib.search(body.get("query") or "", _filters(body), body.get("top_k"))
            provider = {k: getattr(lib.embedder, k) for k in ("id", "model", "semantic")}
            return {"results": _rows(results.orderBy("rank")), **meta.select("applied_weeks", "matched_concepts", "stale_index").first().asDict(), "provider": provider}

        return self._answer(cookie, handle)

    def study(self, cookie: str | None, body: dict) -> Answer:
        return self._answer(cookie, lambda lib, user: lib.study(StudyRequest(user["id"], check_mode(body.get("mode")), body.get("query"), _filters(body))))
