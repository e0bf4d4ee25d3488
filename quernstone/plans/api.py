"""The five tools: load a file, load by glob, query, load sites, list. Arguments and texts are those that callers of such
a service rely on."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_id, url_id
from ..operators.excerpt import NOTHING
from ..operators.hybrid import Fusion
from ..sources.embeddings import EmbedBatch, embed_chunks
from ..sources.files import find_files, read_files
from ..sources.html import html_to_markdown
from ..sources.web import fetch_pages, get
from .answers import answer_each, answer_in_turn, answer_ranked
from .store import IndexStore


def debug_log(folder: str, day: datetime | None = None) -> logging.Logger:
    """A logger that appends to debug-YYYY-MM-DD.txt in the folder."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(f"quernstone.{folder}")
    log.setLevel(logging.DEBUG)
    if not log.handlers:
        log.addHandler(logging.FileHandler(os.path.join(folder, f"debug-{day or datetime.now():%Y-%m-%d}.txt")))
        log.propagate = False
    return log


class Service:
    """Tools over one index store. parity: cross-document answers go document by document; else by rank over all."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], datetime] | None = None, embed: EmbedBatch | None = None, fusion: Fusion | None = None, fetch: Callable[[str], str] | None = get, parity: bool = True, parallel_embeddings: int = 2, logger: logging.Logger | None = None):
        self.spark, self.store = spark, IndexStore(spark, folder)
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.embed, self.fusion, self.fetch, self.parity = embed, fusion or Fusion(), fetch, parity
        self.parallel = max(1, parallel_embeddings)
        self.log = logger or logging.getLogger("quernstone")

    def _load(self, paths: list[str]) -> dict[str, bool]:
        """Index what is new or changed; whether each document came from the store."""
        files = read_files(self.spark, paths)
        read = {r.doc_id for r in files.select("doc_id").collect()}
        stale = self.store.stale(files).persist()
        try:
            fresh = {r.doc_id for r in stale.select("doc_id").collect()}
            if fresh:
                self.store.index(stale, self.clock())
        finally:
            stale.unpersist()
        if fresh and self.embed:
            wanted = self.spark.createDataFrame([(i,) for i in fresh], "doc_id string")
            self.store.put_embeddings(embed_chunks(self.store.chunks().join(wanted, "doc_id", "left_semi"), self.embed, self.parallel))
        return {i: i not in fresh for i in map(path_id, paths) if i in read}

    def docs_load(self, path: str) -> str:
        if not path.strip():
            raise ValueError("path is required")
        if not os.path.isfile(path):
            raise FileNotFoundError(f"read file: open {path}: no such file or directory")
        cached = self._load([path]).get(path_id(path))
        if cached is None:
            raise OSError(f"read file: open {path}: permission denied")
        doc = self.store.get(path_id(path)).first()
        text = ("Loaded from cache." if cached else "Indexed and cached.") + f"\n\ndoc_id: {doc.doc_id}\npath: {doc.path}\nchunks: {doc.num_chunks}\n"
        return text + f"indexed_at: {_stamp(doc.indexed_at)}\n" if cached else text

    def docs_load_glob(self, pattern: str) -> str:
        if not pattern.strip():
            raise ValueError("pattern is required")
        paths = find_files(pattern)
        cached = self._load(paths)
        ids = self.spark.createDataFrame([(i,) for i in cached], "doc_id string")
        total = self.store.documents().join(ids, "doc_id", "left_semi").agg(F.sum("num_chunks")).first()[0] or 0
        failed = len(paths) - len(cached)
        text = f"Loaded {len(cached)} files ({sum(cached.values())} cached), {total} chunks total"
        return text + (f", {failed} failed" if failed else "")

    def docs_query(self, prompt: str, doc_id: str = "", path: str = "", max_tokens: int = 0) -> str:
        prompt, doc_id, path = prompt.strip(), doc_id.strip(), path.strip()
        if not prompt:
            raise ValueError("prompt is required")
        vector = self._vector(prompt)
        query = self.spark.createDataFrame([(0, prompt, max_tokens, vector)], "query_id int, prompt string, max_tokens int, vector array<float>")
        fusion = self.fusion if vector else None
        if not doc_id and not path:
            if self.store.documents().isEmpty():
                raise LookupError("no documents loaded (use docs_load or site_load first)")
            every = answer_in_turn if self.parity else answer_ranked
            return every(self.store.chunks(), query, fusion, posted=self.store.postings()).first().answer
        doc_id = doc_id or path_id(path)
        doc = self.store.get(doc_id).first()
        if doc is None:
            raise LookupError("document not loaded (call docs_load first)")
        if path and doc.path != path:
            raise LookupError(f"cache doc_id exists but path differs: {doc.path} vs {path}")
        got = answer_each(self.store.chunks(doc_id), query, fusion, self.parity, self.store.postings(doc_id)).first()
        return got.answer if got else NOTHING

    def _vector(self, prompt: str) -> list[float] | None:
        if self.embed is None:
            return None
        try:
            return list(map(float, self.embed([prompt])[0]))
        except Exception as e:  # noqa: BLE001  search goes on with BM25
            self.log.warning("no embedding of the prompt: %s", e)
            return None

    def site_loads(self, urls: list[str], force: bool = False) -> str:
        if not urls:
            raise ValueError("urls is required (provide at least one URL)")
        urls = [u.strip() for u in urls if u.strip()]
        if self.fetch is None:
            failed = {u: "site loading not configured (no fetcher)" for u in urls}
            return self._sites(urls, {}, set(), failed)
        ids = {u: url_id(u) for u in urls}
        known = set() if force else {r.doc_id for r in self.store.documents().where(F.col("doc_id").isin(*ids.values()) & F.col("source_url").isNotNull()).select("doc_id").collect()}
        wanted = list(dict.fromkeys(u for u in urls if ids[u] not in known))
        failed: dict[str, str] = {}
        if wanted:
            pages = fetch_pages(self.spark.createDataFrame([(u,) for u in wanted], "url string"), self.fetch).persist()
            try:
                failed = {r.url: r.error for r in pages.where(F.col("error").isNotNull()).collect()}
                good = html_to_markdown(pages.where(F.col("error").isNull()))
                name = F.substring(F.sha2("url", 256), 1, 16)
                files = good.select(name.alias("doc_id"), F.concat(F.lit(f"{self.store.folder}/"), name, F.lit(".md")).alias("path"), F.col("markdown").alias("content"), F.sha2("markdown", 256).alias("file_hash"), F.col("url").alias("source_url")).persist()
                if len(failed) < len(wanted):
                    self.store.index(files, self.clock())
                    if self.embed:
                        self.store.put_embeddings(embed_chunks(self.store.chunks().join(files.select("doc_id"), "doc_id", "left_semi"), self.embed, self.parallel))
                files.unpersist()
            finally:
                pages.unpersist()
        counts = {r.doc_id: r.num_chunks for r in self.store.documents().where(F.col("doc_id").isin(*ids.values())).collect()}
        return self._sites(urls, {u: counts.get(ids[u], 0) for u in urls if u not in failed}, {u for u in urls if ids[u] in known}, failed)

    @staticmethod
    def _sites(urls: list[str], chunks: dict[str, int], cached: set[str], failed: dict[str, str]) -> str:
        lines = [f"- FAILED: {u} ({failed[u]})\n" if u in failed else f"- {u} (chunks: {chunks[u]})\n" for u in urls]
        bad = sum(u in failed for u in urls)
        return f"Loaded {len(urls) - bad} sites ({sum(u in cached for u in urls)} from cache, {bad} failed)\n\n" + "".join(lines)

    def docs_list(self) -> str:
        docs = self.store.list().collect()
        if not docs:
            return "No documents currently loaded. Use docs_load or site_load first."
        out = f"Loaded documents: {len(docs)}\n\n"
        for d in docs:
            url = f"  url: {d.source_url}\n" if d.source_url else ""
            out += f"- doc_id: {d.doc_id}\n{url}  path: {d.path}\n  chunks: {d.num_chunks}\n  indexed_at: {_stamp(d.indexed_at)}\n\n"
        return out


def _stamp(when: datetime) -> str:
    """A timestamp as Spark hands it over, which is in the driver's zone."""
    return when.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
