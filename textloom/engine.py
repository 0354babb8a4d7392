"""The user-facing engine: one object over a documents table and the tables derived from it.

A saved engine is a folder of generations, the largest one with a _DONE file being current:

    <path>/gen-<n>/{docs,postings,vocab,grams,norms,champions,tiers,corpus_stats}    written by save, compact; derived ones also by derive
    <path>/gen-<n>/delta-<m>/{postings,docs}    documents added since; docs are written last and complete it
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import analysis
from textloom.operators import dates, ranked, search
from textloom.operators import index as ix
from textloom.operators.kv import _Folder
from textloom.sources import textdir

#: The derived tables in the order in which they are written, and their keys.
KEYS = {"vocab": "term", "grams": "gram", "norms": "doc_id", "champions": "term", "tiers": "term", "corpus_stats": None}
DERIVED = tuple(KEYS)


class Engine:
    """Search over ``docs(doc_id, text[, path, date, start_date, end_date])``.

    Tables are lazy plans over docs, or, after ``save``/``load``, sorted Parquet tables. Documents that were
    added to a saved engine are deltas: postings are merged with theirs on reading, other tables are derived
    anew until ``compact``.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, profile: str = "surface", path: str | None = None, r: int = 32, sizes: tuple[int, ...] = (16, 64), folders: tuple[str, ...] = ()):
        if profile not in analysis.PROFILES:
            raise ValueError(f"profile must be one of {analysis.PROFILES}")
        self.spark, self.profile, self.path, self.r, self.sizes, self.folders = spark, profile, path, r, tuple(sizes) or (16, 64), tuple(folders)
        missing = [c for c in ("path", *dates.FIELDS) if c not in docs.columns]
        self.docs = docs.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else docs
        self.pending: DataFrame | None = None
        self.counts: dict[str, int] = {}

    # construction
    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, **kw: object) -> Engine:
        return cls(spark, textdir.documents(spark, folder), folders=(folder,), **kw)

    @classmethod
    def load(cls, spark: SparkSession, path: str, profile: str = "surface", **kw: object) -> Engine:
        files = _Folder(spark, path)
        found = [f"{files._dir()}/docs", *(f"{d}/docs" for d in cls._added(files))]
        return cls(spark, ix.spread(spark.read.parquet(*found)), profile, path, **kw)

    @staticmethod
    def _added(files: _Folder) -> list[str]:
        return [p for p in files._children(files._dir()) if re.search(r"/delta-\d+$", p) and files._exists(f"{p}/docs/_SUCCESS")]

    def save(self, path: str, tables: tuple[str, ...] = DERIVED) -> Engine:
        """Write docs, postings and the derived tables, sorted by key, as the next generation below the path; the returned engine
        reads them. Derived tables that are not asked for can be written later, by ``derive``."""
        files = _Folder(self.spark, path)
        fresh = not files._exists(f"{files._dir()}/docs")
        new = files._dir() if fresh else f"{files.path}/gen-{files.gen + 1}"
        self.docs.write.mode("overwrite").parquet(f"{new}/docs")
        out = Engine(self.spark, ix.spread(self.spark.read.parquet(f"{new}/docs")), self.profile, None, self.r, self.sizes)
        ix.write_table(self.postings if self.path else out.postings, f"{new}/postings", "term")
        out.__dict__["postings"] = self.spark.read.parquet(f"{new}/postings")
        out.__dict__["tf"] = out.postings.select("term", "doc_id", "tf")
        for name in DERIVED:
            if name in tables:
                out._write(name, new)
        files.fs.create(files._path(f"{new}/_DONE"), True).close()
        if not fresh:
            files.fs.delete(files._path(files._dir()), True)
        return Engine.load(self.spark, path, self.profile, r=self.r, sizes=self.sizes, folders=self.folders)

    def _write(self, name: str, folder: str) -> None:
        """Write a derived table into a generation's folder and read it from there."""
        if KEYS[name]:
            ix.write_table(getattr(self, name), f"{folder}/{name}", KEYS[name], dealt=name == "tiers")
        else:
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.__dict__[name] = self.spark.read.parquet(f"{folder}/{name}")

    def derive(self, *names: str) -> Engine:
        """This saved engine with the derived tables written that it lacks; while it has deltas, none are."""
        need = {*names, *(("vocab",) if {"grams", "norms", "corpus_stats"} & {*names} else ())}
        for name in DERIVED if self.path and not self._deltas else ():
            if name in need and self._table(name) is None:
                self._write(name, self._files._dir())
        return self

    @cached_property
    def _files(self) -> _Folder | None:
        return _Folder(self.spark, self.path) if self.path else None

    @cached_property
    def _deltas(self) -> list[str]:
        return self._added(self._files) if self.path else []

    def _table(self, name: str) -> DataFrame | None:
        """A saved table; derived ones count only if they were written, and while nothing has been added to them."""
        if not self.path or (name in DERIVED and (self._deltas or not self._files._exists(f"{self._files._dir()}/{name}/_SUCCESS"))):
            return None
        return self.spark.read.parquet(f"{self._files._dir()}/{name}")

    # tables
    @cached_property
    def n_docs(self) -> int:
        return self.docs.count()

    @cached_property
    def postings(self) -> DataFrame:
        found = self._table("postings")
        if found is None:
            return ix.postings(self.docs, self.profile)
        return ix.merge_postings(found.unionByName(self.spark.read.parquet(*(f"{d}/postings" for d in self._deltas)))) if self._deltas else found

    @cached_property
    def tf(self) -> DataFrame:
        return self.postings.select("term", "doc_id", "tf") if self.path else ix.term_frequencies(self.docs, self.profile)

    @cached_property
    def vocab(self) -> DataFrame:
        found = self._table("vocab")
        return ix.vocabulary(self.tf, self.n_docs) if found is None else found

    @cached_property
    def grams(self) -> DataFrame:
        found = self._table("grams")
        return ix.grams(self.vocab) if found is None else found

    @cached_property
    def norms(self) -> DataFrame:
        found = self._table("norms")
        return ix.doc_norms(self.tf, self.vocab) if found is None else found

    @cached_property
    def champions(self) -> DataFrame:
        found = self._table("champions")
        return ix.champions(self.tf, self.r) if found is None else found

    @cached_property
    def tiers(self) -> DataFrame:
        found = self._table("tiers")
        return ix.tiers(self.tf, self.sizes) if found is None else found

    @cached_property
    def corpus_stats(self) -> DataFrame:
        """One row: documents, distinct terms, postings."""
        found = self._table("corpus_stats")
        if found is not None:
            return found
        words = self.vocab.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        return words.select(F.lit(self.n_docs).cast("long").alias("docs"), "terms", "postings")

    # queries
    def query(self, expr: str, loose_operators: bool = False, all_parts: bool = False) -> DataFrame:
        return search.boolean(self.docs, self.tf, expr, self.profile, loose_operators, all_parts)

    def term(self, word: str) -> DataFrame:
        found = analysis.analyze(word, self.profile)
        return search.term_docs(self.tf, found[0]) if found else self.tf.select("doc_id").limit(0)

    def phrase(self, text: str) -> DataFrame:
        return search.phrase(self.postings, text, self.profile)

    def prefix(self, prefix: str) -> DataFrame:
        return search.prefix_docs(self.tf, prefix)

    def prefix_terms(self, prefix: str, limit: int | None = None) -> DataFrame:
        return search.prefix_terms(self.vocab, prefix, limit)

    def wildcard(self, pattern: str) -> DataFrame:
        return search.wildcard_docs(self.tf, pattern)

    def wildcard_terms(self, pattern: str, limit: int | None = 32, use_grams: bool = True) -> DataFrame:
        return search.wildcard_terms(self.vocab, pattern, limit, self.grams if use_grams else None)

    def ranked(self, text: str, k: int = 10, mode: str = "inexact") -> DataFrame:
        if mode == "exact":
            return ranked.top_exact(self.tf, self.norms, self.n_docs, text, k, self.profile)
        if mode != "inexact":
            raise ValueError("mode must be exact or inexact")
        stored = (self.champions, self.tiers) if self.path else (None, None)
        return ranked.top_inexact(self.tf, self.norms, self.n_docs, text, k, self.r, self.sizes, self.profile, *stored)

    # documents
    def list(self) -> DataFrame:
        return self.docs.select("doc_id", "path", *dates.FIELDS).orderBy("doc_id")

    def show(self, doc_id: int, lines: int = 20) -> DataFrame:
        """The metadata and first lines of one document."""
        head = F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n")
        return self.docs.filter(F.col("doc_id") == doc_id).select("doc_id", "path", *dates.FIELDS, head.alias("head"))

    def stats(self) -> DataFrame:
        """(docs, bytes, runs, run_bytes): documents, bytes of their texts, postings tables and their bytes on disk (0 if not saved)."""
        runs = [f"{self._files._dir()}/postings", *(f"{d}/postings" for d in self._deltas)] if self.path else []
        size = sum(self._files.fs.getContentSummary(self._files._path(p)).getLength() for p in runs)
        found = self.docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
        return found.select("docs", "bytes", F.lit(len(runs)).alias("runs"), F.lit(size).cast("long").alias("run_bytes"))

    def add(self, path: str, any_suffix: bool = False) -> Engine:
        """The engine with the new files below a path added; known paths are skipped.

        ``counts`` of the returned engine says how many were added, skipped, and failed (listed but not read).
        Searches see the documents at once; with a saved engine, ``flush`` makes them a delta of its folder.
        """
        fresh = textdir.new_documents(self.spark, self.docs, path, any_suffix)
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        if not any_suffix:
            listed = listed.filter(F.lower("path").rlike(rf"\.({'|'.join(textdir.SUFFIXES)})$"))
        added, total = fresh.count(), listed.count()
        skipped = listed.join(self.docs.select("path"), "path", "left_semi").count()
        columns = [c for c in self.docs.columns if c in textdir.SCHEMA]
        out = self._with(self.docs.unionByName(fresh.select(*columns), allowMissingColumns=True))
        out.path, out.folders, out.counts = self.path, (*self.folders, path), {"added": added, "skipped": skipped, "failed": total - added - skipped}
        if self.path:
            out.pending = fresh if self.pending is None else self.pending.unionByName(fresh)
            held = self.postings.select("term", "doc_id", "positions").unionByName(ix.postings(fresh, self.profile).select("term", "doc_id", "positions"))
            out.__dict__ |= {"_files": self._files, "_deltas": [*self._deltas, "pending"], "postings": ix.merge_postings(held)}
        return out

    def flush(self) -> Engine:
        """The saved engine with its added documents written as a delta: postings first, then docs, which complete it."""
        if self.pending is None:
            return self
        files = _Folder(self.spark, self.path)
        name = f"{files._dir()}/delta-{len(self._added(files)) + 1:08d}"
        ix.write_table(ix.postings(self.pending, self.profile), f"{name}/postings", "term")
        self.pending.write.mode("overwrite").parquet(f"{name}/docs")
        return Engine.load(self.spark, self.path, self.profile, r=self.r, sizes=self.sizes, folders=self.folders)

    def compact(self) -> Engine:
        """The saved engine with all deltas merged into a new generation and every derived table written anew."""
        out = self.flush()
        return out.save(out.path) if out.path else out

    def add_stream(self, path: str) -> DataFrame:
        """This engine's postings merged with those that ``streaming.ingest.stream_postings`` has written below a path."""
        more = self.spark.read.parquet(path).select("term", "doc_id", "positions")
        return ix.merge_postings(self.postings.select("term", "doc_id", "positions").unionByName(more))

    def set_meta(self, doc_id: int, **values: str | None) -> Engine:
        """The engine with a document's metadata changed; the whole of it must be valid, old and new fields together."""
        return self._with(dates.set_meta(self.docs, doc_id, **values))

    def _with(self, docs: DataFrame) -> Engine:
        return Engine(self.spark, docs, self.profile, None, self.r, self.sizes, self.folders)

    def rebuild(self) -> Engine:
        """The engine with the texts its files hold now, under their old ids and metadata, and without saved tables.

        Documents whose file is gone are left out. An engine that was not made from folders keeps its texts.
        """
        return self._with(textdir.reread(self.spark, self.docs, list(dict.fromkeys(self.folders))))
