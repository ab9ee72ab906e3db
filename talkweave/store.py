"""The verbs of a chat store: lists, history, timelines, search, media, exports and change streams.

A store is a handful of DataFrames; every verb composes a plan over them and returns a Page, whose
items stay a DataFrame until they are asked for."""

from __future__ import annotations


from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave import schema as S
from talkweave.functions import labels
from talkweave.functions.content import decode
from talkweave.functions.tokens import Options
from talkweave.operators import export, media, messages, people, privacy, resolve, search, timeline
from talkweave.page import Page, effective_limit
from talkweave.sources import sqlite_files as Q
from talkweave.sources.settings import Settings

#: Page sizes of the verbs where none is asked for.
DEFAULTS = {"sessions": 20, "contacts": 50, "messages": 50, "export": 50, "other": 20}


def ascending(order: str | None, default: bool = False) -> bool:
    """asc or desc; anything else is descending."""
    return default if order is None else order.lower() == "asc"


def shown(value: str | bool | None) -> bool:
    """Only true, 1 and "true" show what is hidden."""
    return value is True or str(value).lower() in ("1", "true")


@dataclass
class ChatStore:
    """messages (schema MESSAGE), sessions, contacts and rooms of one account; own: the account's id."""

    messages: DataFrame
    sessions: DataFrame
    contacts: DataFrame
    chatrooms: DataFrame | None = None
    own: str = ""
    settings: Settings = field(default_factory=Settings)
    index: tuple[DataFrame, DataFrame] | None = None
    warnings: list[str] = field(default_factory=list)
    skipped: int = 0
    months: str | None = None
    index_at: tuple[str, Options] | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, own: str = "", settings: Settings | None = None, core: bool = False, ingested: str | None = None) -> ChatStore:
        """From the SQLite files below root, with what their logs have committed. Contacts and sessions must be there; message shards
        need not, and core leaves them unread. ingested: a folder in which messages are kept; only new and changed shards are read then."""
        from pyspark.errors import AnalysisException

        from talkweave.sources import ingest, sqlite_source

        mounted = sqlite_source.reaches(root)

        def one(name: str, table: str, columns: dict) -> DataFrame:
            if mounted:
                if not any(p.rsplit("/", 1)[-1] == name for p, _ in sqlite_source.listed(root)):
                    raise FileNotFoundError(f"no {name} below {root}")
                schema = T.StructType([T.StructField(c, t) for c, t in columns.items()])
                return sqlite_source.tables(spark, root, schema, table, glob=name).select(*columns, "path", "warning")
            try:
                d = Q.table(Q.files(spark, root, name), table, columns)
                if not Q.files(spark, root, name).limit(1).count():
                    raise FileNotFoundError(f"no {name} below {root}")
            except AnalysisException as e:
                raise FileNotFoundError(f"no {name} below {root}") from e
            return d

        sessions = people.decode_sessions(Q.good(one("session.db", "SessionTable", Q.SESSION_COLUMNS)))
        raw = one("contact.db", "contact", Q.CONTACT_COLUMNS)
        names = people.label_names(Q.good(one("contact.db", "contact_label", Q.LABEL_COLUMNS)))
        rooms = people.decode_chatrooms(Q.good(one("contact.db", "chat_room", Q.ROOM_COLUMNS)))
        if core:
            return cls(spark.createDataFrame([], S.MESSAGE), sessions.filter("decoded").drop("decoded"), people.decode_contacts(Q.good(raw), names), rooms, own, settings or Settings())
        if ingested is not None:
            ingest.step(spark, root, ingested)
            none = F.lit(None).cast("string")
            stored, dictionary = (d.withColumns({"path": none, "warning": none}) for d in (ingest.messages(spark, ingested), ingest.sender_names(spark, ingested)))
        elif mounted:
            stored, dictionary = sqlite_source.raw_messages(spark, root), sqlite_source.sender_names(spark, root)
        else:
            shards = Q.shards(spark, root)
            stored, dictionary = Q.raw_messages(shards), Q.sender_names(shards)
        told = [f"{r.path}: {r.warning}" for r in Q.warnings(stored).collect()]  # one row for each bad file
        # Kept, as every verb reads it: bodies are decoded once, and plans over them stay small.
        decoded = decode(Q.good(stored), Q.good(dictionary), sessions.select(F.col("username").alias("talker"))).cache()
        bad = decoded.filter(~F.col("decoded")).count()
        return cls(decoded.filter("decoded").drop("decoded"), sessions.filter("decoded").drop("decoded"), people.decode_contacts(Q.good(raw), names), rooms, own, settings or Settings(), None, told, bad)

    def cache(self) -> ChatStore:
        """Keeps the decoded tables for queries to come."""
        for d in (self.messages, self.sessions, self.contacts):
            d.cache()
        return self

    def by_months(self, root: str) -> ChatStore:
        """Writes the messages by month below root; pages of history read the months that they need from now on."""
        from talkweave.sources import monthly

        monthly.write(self.messages, root)
        self.months, self.messages = root, monthly.read(self.messages.sparkSession, root).select(*self.messages.columns)
        return self

    @property
    def resolver(self) -> DataFrame:
        return people.names(self.contacts)

    def hidden(self) -> DataFrame:
        return privacy.hidden_ids(self.contacts, self.settings.ignore_contacts, self.settings.ignore_tags)

    def _talker(self, contact: str, show_hidden: bool) -> str:
        return resolve.resolve(self.contacts, contact, self.hidden(), show_hidden).user_name

    def _rendered(self, d: DataFrame, show_hidden: bool | str | None) -> DataFrame:
        """Messages without what is hidden, named and rendered once after that."""
        return people.enrich_messages(d if shown(show_hidden) else privacy.project_messages(d, self.hidden()), self.resolver, self.own)

    def health(self) -> dict[str, int]:
        """How many rows each table has."""
        tables = {"messages": self.messages, "sessions": self.sessions, "contacts": self.contacts, "chatrooms": self.chatrooms}
        return {k: d.count() for k, d in tables.items() if d is not None}

    def list_sessions(self, limit: int = DEFAULTS["sessions"], offset: int = 0, order: str | None = None, show_hidden: bool = False) -> Page:
        """Hidden talkers go before paging; scanned counts them."""
        scanned, d = self.sessions.count(), self.sessions
        if not shown(show_hidden):
            d = privacy.visible(d, self.hidden(), "username")
        total = d.count()
        d = people.enrich_sessions(d, self.resolver, self.own)
        d = d if shown(show_hidden) else privacy.project_sessions(d, self.hidden())
        return Page(people.sessions_page(d, limit, offset, ascending(order)), effective_limit(limit), offset, total, scanned)

    def list_contacts(self, search: str | None = None, limit: int = DEFAULTS["contacts"], offset: int = 0, show_hidden: bool = False) -> Page:
        d = self.contacts if search is None else self.contacts.filter(people.contact_matches(search))
        scanned = d.count()
        d = d if shown(show_hidden) else privacy.visible(d, self.hidden(), "user_name")
        return Page(people.contacts_page(d, None, limit, offset), effective_limit(limit), offset, d.count(), scanned)

    def list_chatrooms(self, username: str | None = None, limit: int = 0, offset: int = 0) -> Page:
        if self.chatrooms is None:
            raise LookupError("no rooms in this store")
        total = self.chatrooms.count()
        return Page(people.chatrooms_page(self.chatrooms, username, limit, offset), effective_limit(limit), offset, total)

    def history(
        self,
        contact: str,
        limit: int = DEFAULTS["messages"],
        offset: int = 0,
        since: int = 0,
        until: int = S.MAX_LONG,
        type: str | None = None,  # noqa: A002
        order: str | None = None,
        keyword: str | None = None,
        around_sort_seq: int | None = None,
        around_server_id: int | None = None,
        after_sort_seq: int | None = None,
        context: int = S.DEFAULT_CONTEXT,
        show_hidden: bool = False,
        count_filtered: bool = False,
    ) -> Page:
        """Messages of a conversation. total counts all of them in range, hidden senders too; with count_filtered those with the keyword."""
        q = messages.MessageQuery(None, since, until, labels.parse_msg_type(type), keyword, limit, offset, ascending(order), around_sort_seq, around_server_id, after_sort_seq, context).validate()
        q = q.with_(talker=self._talker(contact, shown(show_hidden)))
        if self.months is None:
            page = messages.page(self.messages, q)
        else:
            from talkweave.sources import monthly

            page = monthly.page(self.messages.sparkSession, self.months, q)
        d = self._rendered(page, show_hidden)
        up = ascending(order) or any(a is not None for a in (around_sort_seq, around_server_id, after_sort_seq))
        total = messages.count_messages(self.messages, q, count_filtered).first()["total"]
        return Page(d.orderBy(*messages.ordered(up)), effective_limit(limit), offset, total, total, self.skipped, self.warnings)

    def timeline(self, since: int, until: int, limit: int = DEFAULTS["other"], offset: int = 0, type: str | None = None, order: str | None = None, show_hidden: bool = False) -> Page:  # noqa: A002
        hidden = None if shown(show_hidden) else self.hidden()
        if self.months is None:
            rows = timeline.timeline(self.messages, self.sessions, since, until, labels.parse_msg_type(type), hidden)
            total = rows.count()
        else:
            from talkweave.sources import monthly

            rows, total = monthly.timeline(self.messages.sparkSession, self.months, self.sessions, since, until, labels.parse_msg_type(type), hidden, offset + effective_limit(limit), ascending(order))
        return Page(timeline.timeline_page(rows, self.resolver, self.own, hidden, limit, offset, ascending(order)), effective_limit(limit), offset, total)

    def build_index(self, options: Options = Options(), root: str | None = None) -> ChatStore:
        """Searches use the index from now on. root: where it is stored, and read again as long as the messages are the same."""
        self.index = search.build_index(self.messages, options) if root is None else search.stored_index(self.messages, root, options)
        self.index_at = None if root is None else (root, options)
        return self

    def _reopened(self) -> bool:
        """Whether the stored index could be read anew, in its latest version."""
        found = search.read_index(self.messages.sparkSession, *self.index_at) if self.index_at else None
        self.index = found or self.index
        return found is not None

    def search(self, q: str, limit: int = DEFAULTS["other"], offset: int = 0, mode: str | None = None, hide: bool = False, options: Options = Options()) -> Page:
        """By the index if there is one, else by scan; mode ("index", "scan") asks for one. Hidden talkers are found, too, unless hide is set.

        An index that cannot be read is opened once more; if that fails as well, the scan answers with a warning, or, where
        mode is "index", the error is raised."""
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException

        if mode == "index" and self.index is None:
            raise LookupError("no index in this store")
        warnings = list(self.warnings)
        if self.index is not None and mode != "scan":
            try:
                return self._by_index(q, limit, offset, hide, options)
            except (Py4JJavaError, PySparkException) as first:
                failed = first
            try:
                if self._reopened():
                    return self._by_index(q, limit, offset, hide, options)
            except (Py4JJavaError, PySparkException) as again:
                failed = again
            if mode == "index":
                raise failed
            warnings.append(f"the index could not be read, rows were scanned: {type(failed).__name__}")
        known = self.messages.join(self.sessions.select(F.col("username").alias("talker")), "talker", "left_semi")
        hits = people.enrich_messages(search.scan_search(known, q), self.resolver, self.own)
        return self._found(hits, search.scan_page, messages.KEY, limit, offset, hide, None, warnings)

    def _by_index(self, q: str, limit: int, offset: int, hide: bool, options: Options) -> Page:
        hits = search.indexed_search(*self.index, q, options).withColumnRenamed("raw_text", "snippet")
        return self._found(hits, search.index_page, search.INDEX_ORDER, limit, offset, hide, 0, self.warnings)

    def _found(self, hits: DataFrame, paged, keys: tuple[str, ...], limit: int, offset: int, hide: bool, scanned: int | None, warnings: list[str]) -> Page:
        """The page of hits, counted and named."""
        if hide:
            hits = privacy.visible(hits, self.hidden())
        total = hits.count()
        d = paged(hits, limit, offset)
        if "sender_display_name" not in d.columns:
            d = people.with_name(d, "sender", self.resolver, "sender_display_name")
        d = people.with_name(d, "talker", self.resolver, "talker_display_name").withColumn("hit_type", F.lit("message"))
        return Page(d.orderBy(*messages.ordered(False, keys)), effective_limit(limit), offset, total, total if scanned is None else scanned, 0, warnings)

    def search_files(self, rows: DataFrame, names: DataFrame, q: str, limit: int = DEFAULTS["other"], offset: int = 0, hide: bool = False, options: Options = Options()) -> Page:
        """Search in the account's own index files (index_rows, index_names), latest first."""
        hits = search.file_search(rows, names, q, options)
        if hide:
            hits = privacy.visible(hits, self.hidden())
        total = hits.count()
        d = people.with_name(search.file_page(hits, limit, offset), "sender", self.resolver, "sender_display_name")
        d = people.with_name(d, "talker", self.resolver, "talker_display_name").withColumn("hit_type", F.lit("message"))
        return Page(d.orderBy(*messages.ordered(False, search.FILE_ORDER)), effective_limit(limit), offset, total, total)

    def media(self, talker: str, server_id: int, show_hidden: bool = False) -> DataFrame:
        """The media task of a message; none if its sender is hidden in the group."""
        own = self.messages.filter((F.col("talker") == talker) & (F.col("server_id") == server_id))
        if not shown(show_hidden):
            own = privacy.media_allowed(own, self.hidden()).filter("media_allowed").drop("media_allowed")
        return media.classify(own)

    def media_file(self, talker: str, server_id: int, files: DataFrame, links: DataFrame, blobs: DataFrame, show_hidden: bool = False) -> DataFrame:
        """The media task of a message with the path, or for voices the bytes, that it means."""
        return media.located(self.media(talker, server_id, show_hidden), files, links, blobs)

    def export(self, contact: str, since: int = 0, until: int = S.MAX_LONG, limit: int = DEFAULTS["export"], offset: int = 0, order: str | None = "asc", everything: bool = False, show_hidden: bool = False) -> DataFrame:
        """Enriched messages to export; everything is the whole conversation without a page."""
        talker = self._talker(contact, shown(show_hidden))
        q = messages.MessageQuery(talker, since, until, None, None, limit, offset, ascending(order, True)).validate()
        d = messages.filtered(self.messages, q) if everything else messages.page(self.messages, q)
        return self._rendered(d, show_hidden)

    def export_text(self, contact: str, exported_at: str, located: DataFrame | None = None, **how) -> str:
        """The conversation as text. located: media.located() of its messages; those with a file are numbered and listed at the end."""
        talker = self._talker(contact, shown(how.get("show_hidden")))
        d = self.export(contact, **how)
        if located is None:
            d = d.withColumns({"media_kind": F.lit(None).cast("string"), "filename": F.lit(None).cast("string")})
        else:
            own = located.filter("filename is not null").select("talker", *messages.KEY, "media_kind", "filename").distinct()
            d = d.join(own, ["talker", *messages.KEY], "left")
        names = {r.user_name: r.display_name for r in self.resolver.filter(F.col("user_name").isin(talker, self.own)).collect()}
        return export.txt(d, names.get(talker, talker), names.get(self.own, self.own), talker.endswith(S.GROUP_SUFFIX), exported_at)

    def export_to(self, folder: str, contact: str, exported_at: str, format: str = "txt", no_media: bool = False, show_emoji: bool = False, media_in: tuple[DataFrame, DataFrame, DataFrame] | None = None, **how) -> dict:  # noqa: A002
        """Writes the conversation below folder as "txt" or "json", and its media unless no_media; see export_folder.write.

        media_in: (files, links, blobs) of media.located(). how: as of export(); everything is the whole conversation."""
        from talkweave.operators import export_folder

        talker, d = self._talker(contact, shown(how.get("show_hidden"))), self.export(contact, **how)
        names = {r.user_name: r.display_name for r in self.resolver.filter(F.col("user_name").isin(talker, self.own)).collect()}
        who = export_folder.Names(talker, names.get(talker, talker), names.get(self.own, self.own))
        paging = None
        if format == "json":
            q = messages.MessageQuery(talker, how.get("since", 0), how.get("until", S.MAX_LONG))
            limit, offset = (0, 0) if how.get("everything") else (how.get("limit", DEFAULTS["export"]), how.get("offset", 0))
            paging = {"limit": effective_limit(limit), "offset": offset, "total": messages.count_messages(self.messages, q).first()["total"]}
        return export_folder.write(d, folder, who, exported_at, format, None if no_media else media_in, show_emoji, paging, {"skipped": self.skipped} | ({"warnings": self.warnings} if self.warnings else {}))

    def events(self, sessions: DataFrame, new: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Tagged rows of the streams of session listings (with snapshot) and of messages: moved sessions and new messages, for
        streaming.delivery. Cursors move over hidden messages too; talkers that are hidden, and hidden senders in groups, are left out after that."""
        from talkweave.streaming import changes

        moved = privacy.visible(changes.session_events(sessions, known), self.hidden(), "username")
        start = messages.max_seq(self.messages, self.sessions)
        base = messages.watermark(self.messages, self.sessions).first()["watermark"]
        fresh = privacy.visible(changes.new_messages(new, base, start), self.hidden())
        fresh = privacy.drop_hidden_senders(fresh, self.hidden()) if "sender" in fresh.columns else fresh
        return changes.tagged(moved, "session", "username", "snapshot").unionByName(changes.tagged(fresh, "message", "talker", "sort_seq", "server_id"))

    def watch(self, sessions: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Moved sessions of a stream of listings, enriched and redacted."""
        from talkweave.streaming import changes

        moved = privacy.visible(changes.session_events(sessions, known), self.hidden(), "username")
        return privacy.project_sessions(people.enrich_sessions(moved, self.resolver, self.own), self.hidden())


def write_messages(d: DataFrame, path: str) -> None:
    """Decoded messages partitioned by month and clustered by (talker, sort_seq), as queries read them."""
    month = F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM")
    d.withColumn("month", month).repartitionByRange("month", "talker", "sort_seq").sortWithinPartitions("month", "talker", "sort_seq").write.mode("overwrite").partitionBy("month").parquet(path)


