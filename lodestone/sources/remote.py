"""Remote snapshots over HTTP with conditional fetch, changesets from git, and links to hosted records."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import pad4


def fetch_snapshot(url: str, cache_dir: str, token: str | None = None, force: bool = False, opener: Callable = urllib.request.urlopen) -> tuple[str, bool]:
    """(path of a local copy, whether it came from the cache).

    A local path is returned as it is.  The cached ETag and date make the request
    conditional; an unchanged answer, a failed one or a network error gives the cached
    copy, an error without a copy is raised.  The copy's SHA-256 is kept beside it.
    """
    if not url.startswith(("http://", "https://")):
        if not os.path.exists(url):
            raise FileNotFoundError(url)
        return url, False
    os.makedirs(cache_dir, exist_ok=True)
    body, meta = (os.path.join(cache_dir, f"{hashlib.sha256(url.encode()).hexdigest()[:16]}.{x}") for x in ("json", "meta.json"))
    held: dict = {}
    if os.path.exists(meta) and os.path.exists(body):
        with open(meta, encoding="utf-8") as f:
            held = json.load(f)
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    if held and not force:
        headers |= {k: held[v] for k, v in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if held.get(v)}
    try:
        with opener(urllib.request.Request(url, headers=headers)) as answer:
            data, got = answer.read(), dict(answer.headers)
    except (urllib.error.URLError, OSError):  # 304 and other statuses are errors here as well
        if held:
            return body, True
        raise
    with open(body, "wb") as f:
        f.write(data)
    with open(meta, "w", encoding="utf-8") as f:
        json.dump({"url": url, "etag": got.get("ETag"), "last_modified": got.get("Last-Modified"), "fetched_at": time.time(), "content_hash": hashlib.sha256(data).hexdigest()}, f)
    return body, False


def git_diff(repository: str, ref: str | None = None, staged: bool = False, most_bytes: int = 10 << 20) -> str:
    """The diff against ``ref``; else the staged one; else, unless ``staged``, that of the working tree against HEAD.

    Arguments go to git as a vector, never through a shell; a ref may not look like an option.
    """

    def run(*args: str) -> str:
        out = subprocess.run(["git", "-C", repository, "diff", *args], capture_output=True, check=True, shell=False).stdout
        if len(out) > most_bytes:
            raise ValueError(f"the diff has more than {most_bytes} bytes")
        return out.decode("utf-8", "replace")

    if ref:
        if ref.startswith("-"):
            raise ValueError("a ref can't begin with -")
        return run(ref, "--")
    return run("--cached") or ("" if staged else run("HEAD"))


def diff_frame(spark: SparkSession, diffs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(diffs.items()), "diff_id string, diff string")


def _encoded(c: Column) -> Column:
    return F.regexp_replace(F.url_encode(c), r"\+", "%20")


def record_path(base_dir: str, relative: Column, record_id: Column) -> Column:
    """The relative path below the base directory; without one, the padded number as a file name."""
    base = base_dir.strip("/")
    clean = F.regexp_replace(relative, "^/+", "")
    return F.when(F.length(clean) > 0, F.when(clean.startswith(base + "/"), clean).otherwise(F.concat(F.lit(base + "/"), clean))).otherwise(F.concat(F.lit(base + "/"), pad4(record_id), F.lit(".md")))


def record_urls(records: DataFrame, provider: str, settings: dict[str, str], key: str = "id", relative: str = "relative_path") -> DataFrame:
    """Adds ``web_url`` and ``raw_url`` by provider: github, azure-devops, else custom templates.

    Templates know ``{id}``, ``{relativePath}``, ``{filePath}`` and ``{branch}``.
    """
    branch, base = settings.get("branch", "main"), settings.get("base_dir", "docs/adr")
    path = record_path(base, F.coalesce(relative, F.lit("")), F.col(key))
    if provider == "github":
        at = f"{settings['owner']}/{settings['repository']}"
        return records.withColumns({"web_url": F.concat(F.lit(f"https://github.com/{at}/blob/{branch}/"), path), "raw_url": F.concat(F.lit(f"https://raw.githubusercontent.com/{at}/{branch}/"), path)})
    if provider == "azure-devops":
        org, project, repo = (urllib.parse.quote(settings[k], safe="") for k in ("organization", "project", "repository"))
        web = F.concat(F.lit(f"https://dev.azure.com/{org}/{project}/_git/{repo}?path="), _encoded(F.concat(F.lit("/"), path)), F.lit(f"&version=GB{branch}"))
        raw = F.concat(F.lit(f"https://dev.azure.com/{org}/{project}/_apis/git/repositories/{repo}/items?path="), _encoded(F.concat(F.lit("/"), path)), F.lit(f"&versionDescriptor.version={branch}&api-version=7.0"))
        return records.withColumns({"web_url": web, "raw_url": raw})

    def filled(template: str | None) -> Column:
        out = F.lit(template)
        for name, value in (("{id}", F.col(key)), ("{relativePath}", F.coalesce(relative, F.lit(""))), ("{filePath}", path), ("{branch}", F.lit(branch))):
            out = F.replace(out, F.lit(name), value)
        return out

    return records.withColumns({"web_url": filled(settings.get("web_template")), "raw_url": filled(settings.get("raw_template"))})
