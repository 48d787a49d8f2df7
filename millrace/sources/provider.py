"""Reading page images with a service that the caller brings: a function from bytes to blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import

READ = "path string, provider string, blocks array<struct<label:string,content:string>>, fallback_reason string, error string"


class Unavailable(Exception):
    """The service cannot be reached; the next one may be asked. Any other error is a failed read."""


def read_pages(images: DataFrame, providers: list[tuple[str, Callable[[bytes], list[tuple[str, str]]]]], attempts: int = 3) -> DataFrame:
    """images (path, content) -> blocks. Each provider is asked in turn while those before are unavailable; a read that
    fails is tried again, ``attempts`` times in all, and is then an error of its row."""
    workers_import(images.sparkSession)

    def one(content: bytes) -> tuple[str | None, list, str | None, str | None]:
        reasons = []
        for name, read in providers:
            for attempt in range(attempts):
                try:
                    return name, [{"label": a, "content": b} for a, b in read(content)], "; ".join(reasons) or None, None
                except Unavailable as e:
                    reasons.append(f"{name}: {e}")
                    break
                except Exception as e:  # noqa: BLE001  the row carries it
                    if attempt + 1 == attempts:
                        return name, [], "; ".join(reasons) or None, f"{type(e).__name__}: {e}"
        return None, [], "; ".join(reasons), "no provider is available"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "provider": [d[0] for d in done], "blocks": [d[1] for d in done], "fallback_reason": [d[2] for d in done], "error": [d[3] for d in done]})

    return images.select("path", "content").mapInPandas(run, READ)


def blocks_of(payload: DataFrame, key: str, json: str) -> DataFrame:
    """Blocks of a service's JSON answer, whichever of the usual names it uses: key, block_idx, label, content."""
    entries = F.from_json(F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in ("blocks", "parsing_res_list", "result.blocks", "layout")]), "array<map<string,string>>")
    pick = lambda names: F.coalesce(*[F.nullif(F.try_element_at("e", F.lit(n)), F.lit("")) for n in names])
    return payload.select(key, F.posexplode(entries).alias("block_idx", "e")).select(key, "block_idx", pick(("block_label", "label", "type")).alias("label"), pick(("block_content", "content", "text")).alias("content"))
