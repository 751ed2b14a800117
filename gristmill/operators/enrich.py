"""The stages that ask a language model: gated, bounded in width by partitions, with retries; a failure leaves the row pending.

The model itself is behind an injected client, a function from a request to an answer, so that nothing here opens a connection.
"""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.normalize import company_type
from .silver import KEY, gate, write_back

Client = Callable[[dict], dict | None]
_log = logging.getLogger(__name__)


class Refused(Exception):
    """An answer that may be better later: too many requests, or a fault of the server. `after`: seconds it asks to wait."""

    def __init__(self, status: int, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


@dataclass(frozen=True)
class Patience:
    """How a client is called: so many tries, calls a minute in one partition, and a wait that doubles from `wait` seconds up to `longest`."""

    tries: int = 3
    per_minute: float = 30.0
    wait: float = 1.0
    longest: float = 30.0


def patient(client: Client, p: Patience = Patience(), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Client:
    """A client that keeps to a rate and tries again where it is refused with 429 or 5xx; other faults are raised at once."""
    last = [-1e9]

    def call(request: dict) -> dict | None:
        for k in range(p.tries):
            pause = last[0] + 60.0 / p.per_minute - clock()
            if pause > 0:
                sleep(pause)
            last[0] = clock()
            try:
                return client(request)
            except Refused as e:
                if k + 1 == p.tries or not (e.status == 429 or e.status >= 500):
                    raise
                sleep(min(p.longest, e.after if e.after is not None else p.wait * 2**k * (1 + random.random() / 4)))
        return None

    return call


def apply_client(rows: DataFrame, make_client: Callable[[], Client], key: tuple[str, ...], inputs: dict[str, int | None], outputs: dict[str, str], width: int = 5) -> DataFrame:
    """`key` and `outputs` for the rows the client answered; rows on which it raises or answers None are left out and logged, so they stay pending.

    `make_client` runs once a partition and returns a function from inputs to outputs; `inputs` caps texts sent to it, as its interface
    demands. At most `width` partitions call it at a time.
    """
    cut = [(F.substring(c, 1, n) if n else F.col(c)).alias(c) for c, n in inputs.items()]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                try:
                    got = client({c: r[c] for c in inputs})
                except Exception as e:
                    _log.warning("no answer for %s: %s", {k: r[k] for k in key}, e)
                    got = None
                if got is not None:
                    out.append({**{k: r[k] for k in key}, **{c: got.get(c) for c in outputs}})
            if out:
                yield pd.DataFrame(out, columns=[*key, *outputs])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in key), *(f"{c} {t}" for c, t in outputs.items())])
    return rows.select(*key, *cut).repartition(width, *key).mapInPandas(call, schema)


#: What each stage sends, with the length its interface takes, and what comes back.
STAGES = {
    "translate": ({"description_text": 3000}, {"description_text": "string"}),
    "tech": ({"title": None, "description_text": 3000}, {"technologies": "array<string>", "competencies": "array<string>", "seniority_level": "string", "role_category": "string"}),
    "classify": ({"company": None, "description_text": 3000}, {"posting_company_type": "string", "end_client_name": "string", "end_client_sector": "string", "engagement_type": "string"}),
}


def stage(jobs: DataFrame, name: str, make_client: Callable[[], Client], width: int = 5) -> DataFrame:
    """The listings after a stage: those its gate selects get the client's answers, all others stay as they are. A translated text is English."""
    inputs, outputs = STAGES[name]
    got = apply_client(gate(jobs, name), make_client, KEY, inputs, outputs, width)
    if name == "translate":
        got, outputs = got.withColumn("description_language", F.lit("en")), {**outputs, "description_language": "string"}
    return write_back(jobs, got, list(outputs))


def research_companies(companies: DataFrame, make_client: Callable[[], Client], width: int = 5) -> DataFrame:
    """The firms after research: one call for each whose kind is not known, unknown kinds of answers as `unknown`."""
    got = apply_client(gate(companies, "dim_company"), make_client, ("company_id",), {"name": None}, {"org_type": "string"}, width)
    return write_back(companies, got.withColumn("org_type", company_type(F.col("org_type"))), ["org_type"], ("company_id",))


def call_cost(items: int, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> float:
    """Price of calls, for prices per million tokens."""
    return items * (tokens_in * price_in + tokens_out * price_out) / 1e6
