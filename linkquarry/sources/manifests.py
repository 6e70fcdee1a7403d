"""Source manifests, fetched files and storage budgets: what a pipeline checks on the driver before it runs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import urllib.request
from urllib.parse import urlsplit

from linkquarry.sources.index_table import IndexSource


def read_source(path: str) -> IndexSource:
    """A crawl's source manifest, validated field by field."""
    with open(path, encoding="utf-8") as f:
        return parse_source(json.load(f))


def parse_source(value: object) -> IndexSource:
    if not isinstance(value, dict) or value.get("schemaVersion") != 1:
        raise ValueError("unsupported schema of a source manifest")
    index, how = value.get("index"), value.get("sampling")
    number = lambda x, kinds=(int,): isinstance(x, kinds) and not isinstance(x, bool)
    texts = lambda xs: isinstance(xs, list) and xs and all(isinstance(x, str) and x for x in xs)
    if not (
        isinstance(value.get("id"), str) and re.fullmatch("[a-z0-9][a-z0-9-]*", value["id"])
        and isinstance(value.get("crawl"), str) and re.fullmatch("CC-MAIN-[0-9]{4}-[0-9]{2}", value["crawl"])
        and isinstance(value.get("description"), str)
        and isinstance(index, dict) and all(isinstance(index.get(k), str) for k in ("database", "table", "location"))
    ):
        raise ValueError("invalid metadata of a source manifest")
    if not (
        isinstance(how, dict) and how.get("profile") == "balanced-v1" and isinstance(how.get("seed"), str) and how["seed"]
        and number(how.get("candidateMultiplier"), (int, float)) and how["candidateMultiplier"] > 1
        and number(how.get("hostBalancedFraction"), (int, float)) and 0 <= how["hostBalancedFraction"] <= 1
        and number(how.get("maximumUrlsPerHost")) and how["maximumUrlsPerHost"] >= 1
        and number(how.get("hashBuckets")) and how["hashBuckets"] >= 1000
    ):
        raise ValueError("invalid sampling profile")
    if not texts(how.get("protocols")) or not set(how["protocols"]) <= {"http", "https"}:
        raise ValueError("protocols must be http or https")
    if not texts(how.get("mimeTypes")) or not isinstance(how.get("statuses"), list) or not how["statuses"] or not all(map(number, how["statuses"])):
        raise ValueError("statuses and mimeTypes must be lists that aren't empty")
    return IndexSource(value["crawl"], index["location"], how["seed"], tuple(how["protocols"]), tuple(how["statuses"]), tuple(how["mimeTypes"]), how["candidateMultiplier"], how["hashBuckets"], index["table"])


def fetch(url: str, path: str, size: int, sha256: str, force: bool = False) -> bool:
    """Download to path if it isn't there; False if it was. A present file or a download that doesn't match is an error."""

    def digest(name: str) -> tuple[int, str]:
        with open(name, "rb") as f:
            return os.path.getsize(name), hashlib.file_digest(f, "sha256").hexdigest()

    if os.path.exists(path) and not force:
        if digest(path) != (size, sha256):
            raise ValueError(f"{path} is there and doesn't match")
        return False
    part = f"{path}.part"
    with urllib.request.urlopen(url, timeout=30) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out, 1 << 20)
    if digest(part) != (size, sha256):
        os.remove(part)
        raise ValueError(f"{url} doesn't match its size and checksum")
    os.replace(part, path)
    return True


def fetch_rules(url: str, most: int = 1 << 20) -> dict:
    """A published rule list as JSON: 30 seconds, one origin, 1 MiB at most."""
    with urllib.request.urlopen(url, timeout=30) as source:
        if urlsplit(source.geturl())[:2] != urlsplit(url)[:2]:
            raise ValueError("the list moved to another origin")
        data = source.read(most + 1)
    if len(data) > most:
        raise ValueError("the list is too large")
    return json.loads(data)


def folder_bytes(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names)


def check_storage(path: str, budget: int, reserve: int, planned: int = 0) -> None:
    """An error where a folder on this machine would pass its budget or leave less free space than the reserve."""
    used, free = folder_bytes(path), shutil.disk_usage(path).free
    if used + planned > budget:
        raise ValueError(f"{used + planned} bytes are over the budget of {budget}")
    if free - planned < reserve:
        raise ValueError(f"{free - planned} bytes free are less than the reserve of {reserve}")
