"""The store: append-only versions in Parquet, and views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.sources import commits


class Store:
    """Versions of JSON documents: an append-only log of saves and removals.

    A row of the log is a version, or a tombstone that ends all versions of its
    document so far.  Every save or removal is one commit (`commits.Folder`).
    Version numbers follow those that the document has when the commit is
    published: a writer that finds its number of commit taken looks at what the
    others committed, and numbers anew only if that concerns its documents.  So
    two savers of one document get consecutive versions, in any interleaving.

    Each version holds a checksum of its content, and one of that and the content
    of the version before it; each commit says how many rows it has.  So
    `problems` finds versions that were changed or are missing.  `compact` writes the rows that are alive
    as a base, from which readers start.  Record tables are generations: a
    `rebuild` writes all tables hidden and publishes them at once.
    """

    SCHEMA = "org string, doc string, version int, saved_at timestamp_ntz, document string"
    ROW = f"rows long, kind string, {SCHEMA}, content string, link string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits, self.bases, self.generations = (commits.Folder(spark, f"{self.path}/{x}") for x in ("commits", "bases", "generations"))

    # --- reading ---

    def log(self, upto: int | None = None) -> DataFrame:
        """The newest base and the commits after it, as of commit ``upto``."""
        bases = [n for n in self.bases.numbers() if upto is None or n <= upto]
        after = bases[-1] if bases else 0
        later = [n for n in self.commits.numbers() if n > after and (upto is None or n <= upto)]
        rows = self.commits.read(self.ROW, later)
        number = F.regexp_extract("_metadata.file_path", "/([0-9]+)/[^/]*$", 1) if later else F.lit(None)
        rows = rows.select(number.cast("long").alias("commit"), "*")
        return rows.unionByName(self.bases.read(f"commit long, {self.ROW}", bases[-1:])) if bases else rows

    def head(self) -> int:
        """The number of the last commit; 0 for an empty store."""
        return max([0, *self.commits.numbers()[-1:], *self.bases.numbers()[-1:]])

    def versions(self, upto: int | None = None) -> DataFrame:
        """Versions of documents that were not removed since."""
        return self._alive(self.log(upto)).select("org", "doc", "version", "saved_at", "document")

    @staticmethod
    def _alive(log: DataFrame) -> DataFrame:
        ended = log.where("kind = 'remove'").groupBy("org", "doc").agg(F.max("commit").alias("ended"))
        same = log["org"].eqNullSafe(ended["org"]) & (log["doc"] == ended["doc"]) & (log["commit"] <= ended["ended"])
        return log.where("kind = 'save'").join(ended, same, "left_anti")

    def current(self, upto: int | None = None) -> DataFrame:
        held = self.versions(upto)
        return held.groupBy("org", "doc").agg(F.max_by(F.struct("version", "saved_at", "document"), "version").alias("v")).select("doc", "v.version", "org", "v.saved_at", "v.document")

    # --- writing ---

    def save(self, arrivals: DataFrame) -> int:
        """Append ``(org, doc, saved_at, document)``; the number of the commit.

        Documents that are no JSON object, and rows without a doc, are refused.
        Several arrivals of a document are versions in order of saved_at.
        """
        return self.prepare(arrivals).publish()

    def prepare(self, arrivals: DataFrame) -> Pending:
        """A save that nobody sees before it is published."""
        good = arrivals.where(F.col("doc").isNotNull() & F.try_parse_json("document").isNotNull() & F.ltrim("document").startswith("{"))
        return Pending(self, good.select("org", "doc", "saved_at", "document"))

    def remove(self, docs: DataFrame) -> DataFrame:
        """Remove all versions of ``docs(org, doc)``; (org, doc, existed) for each.

        Readers of versions and of record tables leave them out from the commit on.
        """
        asked = docs.where("doc is not null").select("org", "doc").distinct()
        number = Pending(self, asked, "remove").publish()
        gone = self.log(number).where((F.col("commit") == number) & (F.col("kind") == "remove")).select("org", "doc")
        held = self._alive(self.log(number - 1)).select(F.col("org").alias("_org"), F.col("doc").alias("_doc"), F.lit(True).alias("e")).distinct()
        rows = gone.join(held, F.col("org").eqNullSafe(F.col("_org")) & (F.col("doc") == F.col("_doc")), "left")
        return rows.select("org", "doc", F.coalesce("e", F.lit(False)).alias("existed"))

    # --- checking ---

    def problems(self) -> DataFrame:
        """(org, doc, version, problem) of the log: ``edited``, ``missing`` and ``short``.

        A version is edited if a checksum isn't that of its content, or of its
        content and its predecessor's, so an edited version is named together with
        the next one if its own checksum was made to fit; it is missing if only a
        later one of the document is there.  A commit
        whose rows aren't all there, or whose number is missing below a later one,
        is short, with the commit's number as version.  A lost last commit leaves
        no trace.
        """
        log = self.log()
        # versions count from 1 again after a removal: such a life ends with the first tombstone behind it
        order = Window.partitionBy("org", "doc").orderBy("commit", "version")
        lives = log.withColumn("life", F.count_if(F.col("kind") == "remove").over(order)).where("kind = 'save'")
        chain = Window.partitionBy("org", "doc", "life").orderBy("version")
        each = lives.withColumn("now", content()).withColumn("before", F.lag("content").over(chain)).withColumn("last", F.coalesce(F.lag("version").over(chain), F.lit(0)))
        follows = F.col("last") == F.col("version") - 1
        wrong = (F.col("now") != F.col("content")) | (follows & (link(F.col("before"), F.col("content")) != F.col("link")))
        edited = each.where(wrong).select("org", "doc", "version", F.lit("edited").alias("problem"))
        gaps = each.where(F.col("last") < F.col("version") - 1).select("org", "doc", F.explode(F.sequence(F.col("last") + 1, F.col("version") - 1)).alias("version"), F.lit("missing").alias("problem"))
        bases, numbers = self.bases.numbers(), self.commits.numbers()
        start = bases[-1] if bases else 0
        lost = [n for n in range(start + 1, (numbers or [0])[-1]) if n not in set(numbers)]
        counted = log.where(F.col("commit") > start).groupBy("commit").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).where("n <> rows").select("commit")
        empty = [n for n in numbers if n > start]
        held = self.spark.createDataFrame([(n,) for n in empty], "commit long").join(log.select("commit").distinct(), "commit", "left_anti")
        short = counted.unionByName(held).unionByName(self.spark.createDataFrame([(n,) for n in lost], "commit long"))
        none = F.lit(None).cast("string")
        return edited.unionByName(gaps).unionByName(short.select(none.alias("org"), none.alias("doc"), F.col("commit").cast("int").alias("version"), F.lit("short").alias("problem")))

    def compact(self) -> int:
        """Write what is alive as a base; removed versions and tombstones are not in it."""
        upto = self.head()
        hidden = self.bases.hidden()
        self._alive(self.log(upto)).write.parquet(hidden)
        if not self.bases.publish(hidden, upto):
            self.bases.delete(hidden)
        return upto

    def vacuum(self) -> None:
        """Delete commits, bases and generations that no reader of the newest ones needs."""
        bases, generations = self.bases.numbers(), self.generations.numbers()
        for n in bases[:-1]:
            self.bases.delete(self.bases.folder(n))
        for n in self.commits.numbers():
            if bases and n <= bases[-1]:
                self.commits.delete(self.commits.folder(n))
        for n in generations[:-1]:
            self.generations.delete(self.generations.folder(n))

    # --- record tables ---

    def rebuild(self) -> dict[str, tuple[int, int]]:
        """Write every record table anew from the log; rows removed and written by table.

        A reader sees all tables of the old generation or all of the new one.
        Repeating a rebuild changes nothing.  Of two rebuilds at a time the one
        that began later, by the log, is the newer generation.
        """
        upto = self.head()
        before = self.tables()
        hidden = self.generations.hidden()
        documents = self.versions(upto)
        for name, rows in projections(documents, "org").items():
            rows.write.parquet(f"{hidden}/{name}")
        counts = {name: (before.stored(name).count(), self.spark.read.parquet(f"{hidden}/{name}").count()) for name in PROJECTIONS}
        number = max([0, *self.generations.numbers()]) + 1
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.parquet(f"{hidden}/upto")
        while not self.generations.publish(hidden, number):
            if Tables(self, number).upto >= upto:
                self.generations.delete(hidden)
                break
            number += 1
        return counts

    def tables(self) -> Tables:
        """The newest generation of record tables, for as long as the reader holds it."""
        return Tables(self, (self.generations.numbers() or [None])[-1])


class Tables:
    """Record tables of one generation, and what the log has beyond it."""

    def __init__(self, store: Store, generation: int | None):
        self.store, self.generation = store, generation
        self.upto = 0 if generation is None else store.spark.read.parquet(f"{store.generations.folder(generation)}/upto").first().upto

    def stored(self, name: str) -> DataFrame:
        path, item = PROJECTIONS[name]
        if self.generation is None:
            return project(self.store.versions(0), path, f"{RECORD}, {item}", "org")
        return self.store.spark.read.parquet(f"{self.store.generations.folder(self.generation)}/{name}")

    def read(self, name: str) -> DataFrame:
        """A record table as of now: the generation's rows of documents that are still there, and later versions'."""
        log = self.store.log()
        ended = log.where((F.col("kind") == "remove") & (F.col("commit") > self.upto)).select("org", "doc").distinct()
        rows = self.stored(name)
        rows = rows.join(ended, rows["org"].eqNullSafe(ended["org"]) & (rows["doc"] == ended["doc"]), "left_anti")
        path, item = PROJECTIONS[name]
        return rows.unionByName(project(self.store._alive(log).where(F.col("commit") > self.upto), path, f"{RECORD}, {item}", "org"))


class Pending:
    """A save or removal on its way: written hidden, published under the next free number."""

    def __init__(self, store: Store, rows: DataFrame, kind: str = "save"):
        self.store, self.kind, self.hidden = store, kind, None
        self.input = store.commits.hidden()
        rows.write.parquet(self.input)
        self.rows = store.spark.read.schema(rows.schema).parquet(self.input)
        self.n = self.rows.count()
        self._stage()

    def _stage(self) -> None:
        """Write the commit as it follows the log's head."""
        store = self.store
        if self.hidden:
            store.commits.delete(self.hidden)
        self.seen, self.hidden = store.head(), store.commits.hidden()
        rows = self.rows if self.kind == "remove" else self._numbered(store._alive(store.log(self.seen)))
        blank = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in Store.ROW.split(", ")) if c not in (*rows.columns, "rows", "kind")]
        rows.select(F.lit(self.n).cast("long").alias("rows"), F.lit(self.kind).alias("kind"), "*", *blank).write.parquet(self.hidden)

    def _numbered(self, held: DataFrame) -> DataFrame:
        """The arrivals with version, content and link; they follow what ``held`` has of their documents."""
        last = held.groupBy(F.col("org").alias("_org"), F.col("doc").alias("_doc")).agg(F.max_by(F.struct("version", "content"), "version").alias("h"))
        order = Window.partitionBy("org", "doc").orderBy("saved_at", "document")
        new = self.rows.withColumn("k", F.row_number().over(order))
        new = new.join(last, F.col("org").eqNullSafe(F.col("_org")) & (F.col("doc") == F.col("_doc")), "left")
        new = new.withColumn("version", (F.coalesce("h.version", F.lit(0)) + F.col("k")).cast("int")).withColumn("content", content())
        before = F.coalesce(F.lag("content").over(Window.partitionBy("org", "doc").orderBy("version")), F.col("h.content"))
        return new.withColumn("link", link(before, F.col("content"))).select("org", "doc", "version", "saved_at", "document", "content", "link")

    def publish(self) -> int:
        """Make the commit visible; its number.  A commit of nothing is none."""
        store = self.store
        while self.n and not store.commits.publish(self.hidden, self.seen + 1):
            # the number is taken: what was committed meanwhile may concern these documents
            head = store.head()
            theirs = store.log(head).where(F.col("commit") > self.seen).select("org", "doc")
            same = self.rows["org"].eqNullSafe(theirs["org"]) & (self.rows["doc"] == theirs["doc"])
            if self.kind == "save" and not self.rows.join(theirs, same, "left_semi").isEmpty():
                self._stage()
            else:
                self.seen = head
        store.commits.delete(self.input)
        return self.seen + 1 if self.n else self.seen


def content() -> Column:
    """The checksum of a version; lengths keep its parts apart."""
    parts = [F.col("org"), F.col("doc"), F.col("version").cast("string"), F.col("saved_at").cast("string"), F.col("document")]
    return F.sha2(F.concat(*[F.concat(F.coalesce(F.length(p), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]), 256)


def link(before: Column, now: Column) -> Column:
    """The checksum of a version's content and of the content before it."""
    return F.sha2(F.concat(F.coalesce(before, F.lit("")), F.lit(">"), now), 256)


def project(documents: DataFrame, path: str, item: str, *keys: str) -> DataFrame:
    """One row for each record of a collection: keys, doc, version, position, fields.

    ``path`` is a dotted path to a JSON array and ``item`` the records' schema.
    """
    held = F.from_json(F.get_json_object("document", f"$.{path}"), f"array<struct<{item}>>")
    return documents.select(*keys, "doc", "version", F.posexplode(held).alias("position", "r")).select(*keys, "doc", "version", "position", "r.*")


def resolve_company(sightings: DataFrame) -> DataFrame:
    """One company for each tenant and domain, named as it was first seen.

    ``sightings(org, domain, name, seq)``.
    """
    keyed = sightings.withColumn("domain", F.lower(F.trim("domain")))
    return keyed.groupBy("org", "domain").agg(F.min_by("name", "seq").alias("name"), F.count(F.lit(1)).alias("seen"))


def summaries(documents: DataFrame, companies: DataFrame, current: DataFrame, logos: DataFrame, addresses: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """The library's rows: documents with company, current version and counts.

    ``documents(doc, company)``, ``companies(company, name)``, ``current(doc,
    version_id, company_name, completeness)``, ``logos(version_id, position,
    url)``, ``addresses(version_id, is_main, position, line)`` and tables with a
    version_id to count.  First logos and addresses are grouped minima.
    """
    logo = logos.groupBy("version_id").agg(F.min_by("url", "position").alias("logo_url"))
    place = addresses.groupBy("version_id").agg(F.min_by("line", F.struct((~F.col("is_main")).alias("m"), "position")).alias("location"))
    out = documents.join(companies, "company").join(current, "doc", "left").join(logo, "version_id", "left").join(place, "version_id", "left")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("version_id").agg(F.count(F.lit(1)).alias(name)), "version_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("company_name", F.coalesce("company_name", "name")).drop("name", "company")


def attention(fields: DataFrame, current: DataFrame) -> DataFrame:
    """Fields of current versions that a model wrote, that are noted or unsure."""
    return fields.join(current.select("doc", "version"), ["doc", "version"], "left_semi").where(F.col("method").isin("ai-live", "ai-mock") | F.col("note").isNotNull() | (F.col("confidence") < 0.5))


def strangers(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose tenant is not their parent's, or that have no parent."""
    p = parents.select(key, F.col("org").alias("parent_org"))
    return children.join(p, key, "left").where(~F.col("org").eqNullSafe(F.col("parent_org")))


def visible(rows: DataFrame, members: DataFrame, user: Column | int, roles: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the tenants that a user belongs to, in one of the roles if given."""
    mine = members.where(F.col("user") == user)
    if roles:
        mine = mine.where(F.col("role").isin(*roles))
    return rows.join(mine.select("org").distinct(), "org", "left_semi")


def slugs(names: DataFrame) -> DataFrame:
    """``names(id, name)`` with unique slugs: later ones of a name are numbered."""
    base = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("name", F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    root = F.substring(F.when(base == "", "workspace").otherwise(base), 1, 40)
    k = F.row_number().over(Window.partitionBy("root").orderBy("id")) - 1
    return names.withColumn("root", root).withColumn("k", k).withColumn("slug", F.when(F.col("k") == 0, F.col("root")).otherwise(F.concat("root", F.lit("-"), F.col("k").cast("string")))).drop("root", "k")


#: Record tables: where a collection stands in a document, and its columns.
RECORD = "id string, method string, confidence double"
PROJECTIONS = {
    "people": ("people.value", "name string, title string, role string, gender string, bio string, email string, phone string, imageUrl string, profileUrl string, linkedin string"),
    "offerings": ("offerings.value", "name string, category string, description string, features array<string>, pricing string, url string"),
    "testimonials": ("proof.testimonials.value", "quote string, authorName string, authorRole string, authorCompany string, authorLocation string, rating double, date string, platform string"),
    "aggregate_ratings": ("proof.aggregateRatings.value", "platform string, ratingValue double, bestRating double, reviewCount int"),
    "case_studies": ("proof.caseStudies.value", "title string, client string, problem string, solution string, results array<string>, url string"),
    "certifications": ("proof.certifications.value", "name string, issuer string, identifier string, validUntil string, kind string"),
    "memberships": ("proof.memberships.value", "name string, issuer string, identifier string, validUntil string, kind string"),
    "awards": ("proof.awards.value", "name string, issuer string, year int"),
    "press_mentions": ("proof.pressMentions.value", "outlet string, title string, url string, date string, kind string"),
    "trust_stats": ("proof.trustStats.value", "claim string, value double, unit string, category string, asOfDate string"),
    "guarantees": ("proof.guarantees.value", "text string, kind string, terms string"),
    "logos": ("branding.logos.value", "url string, alt string, kind string, width int, height int"),
    "client_logos": ("proof.clientLogos.value", "url string, alt string, kind string, width int, height int"),
    "brand_colors": ("branding.colors.value", "hex string, role string, frequency int"),
    "social_profiles": ("onlinePresence.profiles.value", "platform string, url string, handle string"),
    "content_themes": ("contentIntelligence.themes.value", "label string, weight double, terms array<string>, exampleUrls array<string>"),
    "content_items": ("contentIntelligence.posts.value", "title string, url string, publishedAt string, author string, category string, excerpt string, wordCount int"),
    "headline_patterns": ("contentIntelligence.headlinePatterns.value", "pattern string, count int, examples array<string>"),
    "faqs": ("contentIntelligence.faqs.value", "question string, answer string, topic string"),
    "glossary_terms": ("contentIntelligence.glossary.value", "term string, definition string"),
    "seasonal_signals": ("contentIntelligence.seasonalSignals.value", "label string, period string, text string"),
    "content_gaps": ("contentIntelligence.contentGaps.value", "topic string, reason string, relatedOffering string"),
    "conflicts": ("quality.conflicts", "path string, label string, resolved boolean"),
    "follow_up_questions": ("quality.followUpQuestions", "question string, example string, fills array<string>, priority double, answered boolean"),
    "scrape_pages": ("scrape.pages", "url string, role string, status int, bytes long"),
    "scrape_warnings": ("scrape.warnings", "code string, message string, url string"),
}


def projections(documents: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """Every record table as a view of ``documents(doc, version, document)`` with ``keys``."""
    return {name: project(documents, path, f"{RECORD}, {item}", *keys) for name, (path, item) in PROJECTIONS.items()}


def provenance(documents: DataFrame) -> DataFrame:
    """One row for each field of a document: its envelope, and whether it is filled.

    An empty list or a blank string is a value but not a filled field.
    """
    every = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object("document", f"$.{p}").alias("e")) for p, *_ in fields.FIELDS])
    each = documents.select("doc", "version", F.inline(every)).where("e is not null")
    value = F.get_json_object("e", "$.value")
    return each.select(
        "doc", "version", "path", F.get_json_object("e", "$.method").alias("method"), F.get_json_object("e", "$.confidence").try_cast("double").alias("confidence"),
        F.get_json_object("e", "$.note").alias("note"), value.isNotNull().alias("value_present"), (value.isNotNull() & (F.trim(value) != "") & (value != "[]")).alias("is_filled"),
    )
