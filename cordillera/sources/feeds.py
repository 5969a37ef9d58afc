"""Literature services: a paged source, and each service's payload as paper rows.

`Paged` reads any service that answers (cursor) -> body; what calls the network is a function the user names, so tests
and offline runs name one that reads fixtures. The mappers take a frame with the column `body` and stay JVM-side.
"""

from __future__ import annotations

import importlib
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("id", "doi", "title", "authors", "venue", "abstract", "year", "source", "url")


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One for each window in `windows` (comma-separated, dates or shards); they are fetched apart from each other."""
        return [InputPartition(w) for w in self.options.get("windows", "").split(",")]

    def read(self, partition: InputPartition):
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        cursor, most = 0, int(self.options.get("limit", "1000000000"))
        while cursor < most:
            body, items, total = fetch(partition.value, cursor)
            if not items:
                return
            yield partition.value, cursor, body
            cursor += items
            if total is not None and cursor >= total:
                return


class Paged(DataSource):
    """Options: fetch, "module:function" giving (body, items on the page, total or None) for (window, cursor); windows; limit,
    in items of a window, after which no further page is asked for."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "window string, cursor long, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def _names(x: Column) -> Column:
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")


def crossref(pages: DataFrame) -> DataFrame:
    """A page of works as papers: titles joined, names given before family, the year from the first date part."""
    schema = "message struct<items array<struct<DOI string, title array<string>, author array<struct<given string, family string>>, published struct<`date-parts` array<array<int>>>, `container-title` array<string>, URL string, type string, abstract string>>>"
    w = pages.select(F.explode(F.from_json("body", schema)["message"]["items"]).alias("w")).select("w.*")
    doi = F.coalesce(F.col("DOI"), F.lit(""))
    full = F.transform("author", lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    year = F.try_element_at(F.try_element_at(F.col("published")["date-parts"], F.lit(1)), F.lit(1))
    return w.select(F.concat(F.lit("DOI:"), F.lower(doi)).alias("id"), doi.alias("doi"), F.concat_ws(" ", "title").alias("title"), _names(full).alias("authors"), F.concat_ws(" ", F.col("container-title")).alias("venue"), F.coalesce("abstract", F.lit("")).alias("abstract"), year.alias("year"), F.lit("crossref").alias("source"), F.coalesce(F.nullif(F.col("URL"), F.lit("")), F.concat(F.lit("https://doi.org/"), doi)).alias("url"), F.coalesce("type", F.lit("")).alias("document_type"))


def preprints(pages: DataFrame, server: str, query: str = "") -> DataFrame:
    """Rows of a preprint server's pages whose title or abstract has every word of the query, case ignored."""
    p = pages.select(F.explode(F.from_json("body", "collection array<struct<doi string, title string, abstract string, authors string, date string, version string, category string>>")["collection"]).alias("p")).select("p.*")
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    for word in query.lower().split():
        p = p.where(F.contains(text, F.lit(word)))
    doi = F.coalesce("doi", F.lit(""))
    year = F.when(F.col("date").rlike("^[0-9]{4}"), F.substring("date", 1, 4).cast("int"))
    return p.select(F.concat(F.lit(server.upper() + ":"), doi).alias("id"), doi.alias("doi"), F.coalesce("title", F.lit("")).alias("title"), _names(F.split("authors", ";")).alias("authors"), F.lit(server).alias("venue"), F.coalesce("abstract", F.lit("")).alias("abstract"), year.alias("year"), F.lit(server).alias("source"), F.concat(F.lit(f"https://www.{server}.org/content/"), doi).alias("url"), "version", "category")


def _parts(body: Column, tag: str) -> Column:
    return F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))


def _read(entity: str, sign: str, text: Column) -> Column:
    return F.replace(text, F.lit(entity), F.lit(sign))


def _plain(x: Column, tag: str) -> Column:
    """The texts of all <tag> elements, tags within them dropped, entities read."""
    bare = F.transform(_parts(x, tag), lambda t: F.trim(F.regexp_replace(t, "<[^>]+>", "")))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.transform(bare, partial(_read, entity, sign))
    return bare


def _first(x: Column) -> Column:
    return F.coalesce(F.try_element_at(x, F.lit(1)), F.lit(""))


def arxiv(pages: DataFrame) -> DataFrame:
    """Entries of an Atom feed; the id is what follows /abs/."""
    e = pages.select(F.explode(_parts(F.col("body"), "entry")).alias("e"))
    raw = F.element_at(F.split(_first(_plain(F.col("e"), "id")), "/abs/"), -1)
    return e.select(F.concat(F.lit("ARXIV:"), raw).alias("id"), F.lit("").alias("doi"), _squeezed(_first(_plain(F.col("e"), "title"))).alias("title"), _names(_plain(F.col("e"), "name")).alias("authors"), F.lit("arXiv").alias("venue"), _squeezed(_first(_plain(F.col("e"), "summary"))).alias("abstract"), F.substring(_first(_plain(F.col("e"), "published")), 1, 4).try_cast("int").alias("year"), F.lit("arxiv").alias("source"), F.concat(F.lit("https://arxiv.org/abs/"), raw).alias("url"))


def arxiv_query(query: str = "", author: str = "", category: str = "", ids: tuple[str, ...] = (), sort: str = "relevance", most: int = 10) -> dict[str, str]:
    """The parameters of a feed request: ids alone, or fields joined by AND."""
    fields = [f"{k}:{v}" for k, v in (("all", query), ("au", author), ("cat", category)) if v]
    order = {"relevance": "relevance", "date": "submittedDate", "updated": "lastUpdatedDate"}[sort]
    asked = {"id_list": ",".join(ids)} if ids else {"search_query": " AND ".join(fields)}
    return asked | {"start": "0", "max_results": str(most), "sortBy": order, "sortOrder": "descending"}


def pubmed(pages: DataFrame) -> DataFrame:
    """Articles of an XML set: abstract parts joined, fore name before last name."""
    a = pages.select(F.explode(_parts(F.col("body"), "PubmedArticle")).alias("a"))
    x = F.col("a")
    pmid = _first(_plain(x, "PMID"))
    authors = F.transform(_parts(x, "Author"), lambda t: F.concat_ws(" ", F.nullif(_first(_plain(t, "ForeName")), F.lit("")), F.nullif(_first(_plain(t, "LastName")), F.lit(""))))
    doi = F.regexp_extract(x, r'<ArticleId\s+IdType="doi"\s*>\s*([^<]*?)\s*</ArticleId>', 1)
    return a.select(F.concat(F.lit("PMID:"), pmid).alias("id"), doi.alias("doi"), _first(_plain(x, "ArticleTitle")).alias("title"), _names(authors).alias("authors"), _first(_plain(_first(_parts(x, "Journal")), "Title")).alias("venue"), F.array_join(_plain(x, "AbstractText"), " ").alias("abstract"), _first(_plain(x, "Year")).try_cast("int").alias("year"), F.lit("pubmed").alias("source"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"))


def verified(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """citations (kind, identifier) with found: whether the registry of known identifiers has them, case ignored."""
    key = [F.lower("kind").alias("kind"), F.lower(F.trim("identifier")).alias("key")]
    known = registry.select(*key).distinct().withColumn("found", F.lit(True))
    return citations.withColumn("key", F.lower(F.trim("identifier"))).join(known, ["kind", "key"], "left").select("kind", "identifier", F.coalesce("found", F.lit(False)).alias("found"))


def checked(spark, path: str, manifest: DataFrame) -> DataFrame:
    """Files under path against manifest (name, sha256, bytes): name and what is wrong, missing ones too."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("has"), "length")
    return manifest.join(files, "name", "left").select("name", F.when(F.col("has").isNull(), "missing").when(F.col("has") != F.lower("sha256"), "checksum").when(F.col("length") != F.col("bytes"), "size").alias("problem")).where("problem is not null")
