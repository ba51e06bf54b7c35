"""Records of outside services. Requests run on the driver only; reshaping is done in Spark."""

from __future__ import annotations

import json
import shutil
import tarfile
import time
import urllib.error
import urllib.parse
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "struct<uid:string,status:string,rank:string,division:string,scientificname:string,commonname:string,taxid:long>"


def fetch_text(url: str, params: dict | None = None, tries: int = 5, wait: float = 2.0, opener=urllib.request.urlopen, sleep=time.sleep) -> str | None:
    """GET with at most ``tries`` attempts and doubling waits; a 429 answer's Retry-After is honoured, a last 429 gives None, other errors give their body."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for k in range(tries):
        try:
            with opener(full) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code != 429:
                return e.read().decode(errors="replace")
            if k + 1 < tries:
                sleep(float(e.headers.get("Retry-After") or wait * 2**k))
    return None


def fetch_json(url: str, params: dict | None = None, **how):
    """Decoded JSON, or the text where it is none."""
    text = fetch_text(url, params, **how)
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return text


def taxa_ids(names: list[str], base: str, **how) -> dict | None:
    """Search for names, then the summaries of what is found. ``base`` is the service's address."""
    found = fetch_json(f"{base}/esearch.fcgi", {"db": "taxonomy", "term": " OR ".join(names), "retmode": "json"}, **how)
    ids = found.get("esearchresult", {}).get("idlist", []) if isinstance(found, dict) else []
    return fetch_json(f"{base}/esummary.fcgi", {"db": "taxonomy", "id": ",".join(ids), "retmode": "json"}, **how) if ids else None


def download(url: str, folder: str, extract: bool = False, opener=urllib.request.urlopen) -> str:
    """A file of ``url`` in ``folder``, unless it is there; ``extract`` unpacks a tar archive beside it."""
    name = Path(urllib.parse.urlparse(url).path).name
    to = Path(folder, name)
    to.parent.mkdir(parents=True, exist_ok=True)
    if not to.exists():
        with opener(url) as answer, to.open("wb") as out:
            shutil.copyfileobj(answer, out)
    if extract:
        with tarfile.open(to) as archive:
            archive.extractall(folder, filter="data")
    return str(to)


def summarize_taxa_ids(df: DataFrame, column: str = "value", record: str = RECORD) -> DataFrame:
    """One row for each record under ``result`` of a JSON answer, keys that contain ``uids`` skipped; undecodable rows give none."""
    held = F.from_json(F.get_json_object(column, "$.result"), "map<string,string>")
    pairs = df.select(F.explode(F.map_entries(held)).alias("e")).where(~F.contains(F.col("e.key"), F.lit("uids")))
    return pairs.select(F.col("e.key").alias("key"), F.from_json("e.value", record).alias("r")).select("key", "r.*")
