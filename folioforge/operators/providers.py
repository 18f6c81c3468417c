"""Providers of readings and replies: chains, breakers, and their replay over events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOPS = ("auth", "bad_request", "unsupported", "schema", "internal", "cancelled")  # kinds of errors that end a chain
FAILURES, COOLDOWN = 5, 30.0


class ProviderError(Exception):
    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


def chained(providers: list[Callable]) -> Callable:
    """Calls providers in order until one answers; errors in STOPS end the chain at once."""

    def call(request):
        said = []
        for p in providers:
            try:
                return p(request)
            except ProviderError as e:
                said.append(e)
                if e.kind in STOPS:
                    raise
        raise ProviderError(said[-1].kind if said else "no_provider", "; ".join(map(str, said)))

    return call


class Breaker:
    """Opens after `failures` consecutive opening errors, lets one trial through after `cooldown` seconds."""

    OPENING = ("unavailable", "rate_limited", "timeout")

    def __init__(self, provider: Callable, failures: int = FAILURES, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.monotonic):
        self.provider, self.failures, self.cooldown, self.clock = provider, failures, cooldown, clock
        self.count, self.opened, self.trial = 0, None, False

    def __call__(self, request):
        if self.opened is not None:
            if self.trial or self.clock() - self.opened < self.cooldown:
                raise ProviderError("unavailable", "breaker open")
            self.trial = True
        try:
            got = self.provider(request)
        except ProviderError as e:
            if e.kind in self.OPENING:
                self.count += 1
                if self.trial or self.count >= self.failures:
                    self.opened = self.clock()
            self.trial = False
            raise
        self.count, self.opened, self.trial = 0, None, False
        return got


def generate(requests: DataFrame, provider: Callable[[str], str], parallel: int) -> DataFrame:
    """(doc_id, reply, error): one provider call per request, at most `parallel` at a time; an error is a row, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, request in zip(pdf["doc_id"], pdf["request"], strict=True):
                try:
                    reply = provider(request)
                    rows.append((doc, reply, None) if reply and reply.strip() else (doc, None, "bad_response"))
                except ProviderError as e:
                    rows.append((doc, None, e.kind))
                except Exception:  # a provider's own failure is this row's
                    rows.append((doc, None, "internal"))
            yield pd.DataFrame(rows, columns=["doc_id", "reply", "error"])

    return requests.select("doc_id", "request").repartition(parallel).mapInPandas(run, "doc_id long, reply string, error string")


WORDS = "doc_id long, page int, i int, text string, minx double, miny double, maxx double, maxy double, line int, conf double, provider string, error string"


@dataclass(frozen=True)
class Ocr:
    """A provider of OCR: page(image) gives a page's words as (text, minx, miny, maxx, maxy, line, conf) in points from the top left, in
    reading order; document(content), for those that read whole files, gives such a list for every page, in order."""

    name: str
    page: Callable[[bytes], list[tuple]] | None = None
    document: Callable[[bytes], list[list[tuple]]] | None = None


def chained_ocr(providers: list[Ocr]) -> Ocr:
    """Providers in order; whole documents go to those that read them. The name is that of the chain."""
    of = lambda calls: chained(calls) if calls else None
    return Ocr("+".join(p.name for p in providers), of([p.page for p in providers if p.page]), of([p.document for p in providers if p.document]))


def guarded(provider: Ocr, failures: int = FAILURES, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.monotonic) -> Ocr:
    """A provider behind one breaker for both of its calls."""
    breaker = Breaker(lambda call: call[0](call[1]), failures, cooldown, clock)
    of = lambda call: (lambda request: breaker((call, request))) if call else None
    return Ocr(provider.name, of(provider.page), of(provider.document))


def recognise(pages: DataFrame, provider: Ocr, parallel: int) -> DataFrame:
    """WORDS rows of page images (doc_id, page, image), one call per page, at most `parallel` at a time; a page that fails is one row with its error."""
    return _words(pages.select("doc_id", "page", "image"), provider.name, (lambda image: [provider.page(image)]) if provider.page else None, parallel)


def recognise_documents(files: DataFrame, provider: Ocr, parallel: int) -> DataFrame:
    """WORDS rows of whole files (doc_id, content); a file that fails, or of which nothing is read, is one row with its error."""
    return _words(files.select("doc_id", F.lit(1).alias("page"), "content"), provider.name, provider.document, parallel)


def _words(given: DataFrame, name: str, read: Callable | None, parallel: int) -> DataFrame:
    columns = [part.split()[0] for part in WORDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, first, content in pdf.itertuples(index=False):
                rows = []
                try:
                    if read is None:
                        raise ProviderError("unsupported")
                    for k, words in enumerate(read(bytes(content))):
                        rows += [(doc, int(first) + k, i, *w, name, None) for i, w in enumerate(words or [])]
                    if not rows:
                        raise ProviderError("no_content")
                except ProviderError as e:
                    rows = [(doc, int(first), *[None] * 8, name, e.kind)]
                except Exception:  # a provider's own failure is this row's
                    rows = [(doc, int(first), *[None] * 8, name, "internal")]
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("page", "i", "line")} | {c: "float64" for c in ("minx", "miny", "maxx", "maxy", "conf")})

    return given.repartition(parallel).mapInPandas(run, WORDS)


def replay(calls: DataFrame, failures: int = FAILURES) -> DataFrame:
    """(provider, episodes, longest): runs of `failures` or more consecutive failed calls, by gaps and islands in time order.

    calls: provider, ts, call, failed. A run's number is the count of successes before it, so one running sum per
    provider finds all runs. It counts runs and holds no calls back; breaker_states() of the streaming package does.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("provider").orderBy("ts", "call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = calls.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w)).filter("failed").groupBy("provider", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("provider").agg(F.count_if(F.col("n") >= failures).alias("episodes"), F.max("n").alias("longest"))
