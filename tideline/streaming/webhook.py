"""A sink that posts deliveries to a webhook. Nothing starts it by default."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as d


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def post(url: str, body: bytes, timeout: float) -> int:
    """The status of one POST without redirects; 0 if there was no answer."""
    opener = urllib.request.build_opener(_NoRedirect)
    try:
        with opener.open(urllib.request.Request(url, body, {"Content-Type": "application/cloudevents+json"}), timeout=timeout) as r:
            return r.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 0


def delivered(rows: DataFrame, url: str, parallel: int, timeout: float = 10.0, largest: int = 1 << 20, send: Callable[[str, bytes, float], int] = post) -> DataFrame:
    """rows(event_id, envelope) with the status and class (ack, retry, permanent) of one try each, over `parallel` connections.

    An envelope over `largest` bytes is not sent. Spark may run a task again, so receivers must know events by their id.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"event_id": f["event_id"], "status": [413 if len(b) > largest else send(url, b, timeout) for b in (e.encode() for e in f["envelope"])]})

    tried = rows.select("event_id", "envelope").repartition(parallel).mapInPandas(run, "event_id bigint, status int")
    return tried.withColumn("class", F.when(F.col("status") == 0, "retry").otherwise(d.http_class(F.col("status"))))
