"""One object for a vault: its tables, built once and written to the shared folder, and the questions that can be put to it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import RANKING
from marginalia.functions import text as tx
from marginalia.operators import access, audit, delivery, fusion, graph, history, lanes, linking, structure, temporal
from marginalia.operators import index as ix
from marginalia.session import materialize, ship, together


class Vault:
    """corpus: sources.vault.corpus(). A scoped vault is one over the rows an agent may read, so that all statistics are too."""

    def __init__(self, corpus: DataFrame, chunks: DataFrame | None = None, named: DataFrame | None = None, keep: bool = True):
        self.spark: SparkSession = corpus.sparkSession
        ship(self.spark)
        self.corpus, self.chunks, self.named = corpus, chunks, named
        self._keep = materialize if keep else (lambda df, name: df)
        # the index outlives the question it was first built for
        self._index = (lambda df, name: materialize(df, name, keep=True)) if keep else (lambda df, name: df)

    def scoped(self, agent: DataFrame) -> Vault:
        """The vault as an agent (read_scopes, deny_read) sees it."""
        chunks = None if self.chunks is None else access.scoped(self.chunks, agent)
        named = None if self.named is None else access.scoped(self.named, agent)
        return Vault(access.scoped(self.corpus, agent), chunks, named)

    @cached_property
    def fields(self) -> DataFrame:
        return self._index(ix.fields(self.corpus), "fields")

    @cached_property
    def terms(self) -> DataFrame:
        return self._index(ix.terms(self.fields), "terms")

    @cached_property
    def lengths(self) -> DataFrame:
        return ix.lengths(self.fields)

    @cached_property
    def stats(self) -> DataFrame:
        return self._index(ix.stats(self.lengths), "stats")

    @cached_property
    def doc_freq(self) -> DataFrame:
        return self._index(ix.doc_freq(self.terms), "doc-freq")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return self._index(ix.vocabulary(self.doc_freq), "vocabulary")

    @cached_property
    def words(self) -> DataFrame:
        """The vocabulary's words alone: from the index if it is there, else without building it."""
        return self.vocabulary.select("term") if "vocabulary" in self.__dict__ else self._index(ix.words(self.corpus), "words")

    @cached_property
    def postings(self) -> DataFrame:
        return self.terms.where("tf_body > 0").select("note_id", "term", F.col("tf_body").alias("tf"))

    @cached_property
    def priors(self) -> DataFrame:
        return self.corpus.select("note_id", tx.source_prior(F.col("path")).alias("prior"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._index(graph.build(self.corpus, self.named), "edges")

    @cached_property
    def dates(self) -> DataFrame:
        return self._index(temporal.dated(self.corpus).select("note_id", "date"), "dates")

    def question_terms(self, questions: DataFrame) -> DataFrame:
        """(qid, term, n, at, df, idf, ...): words of no note are replaced by their correction, or else by an inflection of theirs."""
        q = ix.question_terms(questions.select("qid", tx.strip_frames(F.substring("question", 1, 4000)).alias("question")))
        q = self._keep(lanes.with_idf(q, self.doc_freq, self.stats), "question-terms")
        fixed = lanes.corrections(q, self.vocabulary, self.stats).select("qid", "term", F.col("correction").alias("new"))
        rare = q.where((F.col("df") < 3) & (F.instr("term", " ") == 0))
        varied = lanes.morph_variants(self.doc_freq, rare)
        x = q.select("qid", "term", "n", "at").join(fixed, ["qid", "term"], "left").join(varied, "term", "left")
        x = x.select("qid", F.coalesce("new", "variant", "term").alias("term"), "n", "at").groupBy("qid", "term").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        return self._keep(lanes.with_idf(x, self.doc_freq, self.stats), "question-terms-corrected")

    def warm(self) -> None:
        """Builds what is missing of the index, independent tables at the same time."""
        self.terms  # noqa: B018
        together(lambda: self.doc_freq, lambda: self.stats, lambda: self.edges, lambda: self.dates)
        together(lambda: self.vocabulary, lambda: self.links)

    @cached_property
    def links(self) -> tuple[DataFrame, DataFrame]:
        """(src, dst) and (note_id, backlinks) of the graph by note_id."""
        ids = self.corpus.select("note_id", "path")
        s, d = (ids.select(F.col("path").alias(c), F.col("note_id").alias(i)) for c, i in (("src", "s"), ("dst", "d")))
        adj = graph.adjacency(self.edges).join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        return self._index(adj, "links"), self._index(graph.backlinks(self.edges).join(ids, "path").select("note_id", "backlinks"), "backlinks")

    def recall(self, questions: DataFrame, vectors: DataFrame | None = None, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(answers, outcomes) of questions (qid, question): (qid, note_id, path, score, rank) and (qid, found, gate_cover, absent,
        reason, dropped, clarify). All lanes rank all notes for all questions at once.

        A comparison is asked as its two sides too and answered by both in turn if either is found. A refused question of three
        words or more is asked again without its least telling word, which `dropped` names. `clarify` holds the notes among which
        the asker is to choose. vectors (qid, vec) of the questions open the semantic lane over the vault's chunks; as_of (a
        date, else today) is the day after which a note has not happened. Refused questions have no answers. A qid lies
        between -2**60 and 2**60."""
        sides = self._keep(fusion.compare_sides(questions), "sides")
        asked = questions.select((F.col("qid") * 4).alias("qid"), "question").unionByName(sides.select((F.col("qid") * 4 + 1 + F.col("side")).alias("qid"), "question"))
        vecs = None if vectors is None else vectors.select((F.col("qid") * 4).alias("qid"), "vec")
        answers, outcomes, q = self._ask(asked, vecs, as_of)
        whole = F.pmod(F.col("qid"), F.lit(4)) == 0
        less = self._keep(fusion.relax(q, outcomes.where(~F.col("found") & whole)), "dropped-terms")
        outcomes = outcomes.withColumn("dropped", F.lit(None).cast("string"))
        if not less.isEmpty():
            again = asked.join(less, "qid").select("qid", "term", tx.rewrite_token(F.col("question"), F.col("term"), F.lit(" ")).alias("question"))
            answers2, outcomes2, _ = self._ask(again.select("qid", "question"), None if vecs is None else vecs.join(less, "qid", "left_semi"), as_of)
            found = self._keep(outcomes2.where("found").join(less.select("qid", F.col("term").alias("dropped")), "qid"), "relaxed")
            answers = answers.join(found, "qid", "left_anti").unionByName(answers2.join(found, "qid", "left_semi"))
            outcomes = outcomes.join(found, "qid", "left_anti").unionByName(found)
        answers = answers.join(outcomes.where("found").select("qid"), "qid", "left_semi")
        # comparisons: both sides in turn where one is found, else the question as it was asked
        own, part = F.floor(F.col("qid") / 4).cast(questions.schema["qid"].dataType), F.pmod(F.col("qid"), F.lit(4))
        answers, outcomes = answers.withColumn("part", part).withColumn("qid", own), outcomes.withColumn("part", part).withColumn("qid", own)
        compared = outcomes.where("part > 0 and found").select("qid").distinct()
        halves = answers.join(compared, "qid", "left_semi")
        turn = fusion.interleave(halves.where("part = 1"), halves.where("part = 2"))
        scores = halves.where("part > 0").groupBy("qid", "note_id", "path").agg(F.max("score").alias("score"))
        turn = turn.join(scores, ["qid", "note_id"]).select("qid", "note_id", "path", "score", "rank")
        plain = answers.where("part = 0").join(compared, "qid", "left_anti").select("qid", "note_id", "path", "score", "rank")
        none = F.array().cast(outcomes.schema["clarify"].dataType)
        of_turn = outcomes.where("part > 0").join(compared, "qid", "left_semi").groupBy("qid").agg(F.lit(True).alias("found"), F.max("gate_cover").alias("gate_cover"), F.min("absent").alias("absent")).select("*", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("dropped"), none.alias("clarify"))
        every = outcomes.where("part = 0").join(compared, "qid", "left_anti").drop("part").unionByName(of_turn)
        return plain.unionByName(turn), every

    def _ask(self, questions: DataFrame, vectors: DataFrame | None, as_of: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One pass of recall(): answers, outcomes (with clarify) and the questions' terms."""
        k, keep = RANKING, self._keep
        self.warm()
        q = self.question_terms(questions)
        ids = self.corpus.select("note_id", "path")
        title, bm, known = together(
            lambda: keep(lanes.ranked(lanes.title(q, self.corpus), k.lane_depth), "title"),
            lambda: keep(lanes.bm25f_best(q, self.fields, self.stats, k.lane_depth), "bm25"),
            lambda: keep(fusion.known_item(q, self.terms, self.lengths, self.doc_freq, self.stats, self.corpus), "known"),
        )
        rare = lanes.ranked(lanes.rare(q, self.postings, self.priors), k.rare_depth, F.desc("prior"))
        pool = keep(lanes.pool((bm.drop("rank"), k.lane_depth), (title.drop("rank"), 30), (rare.select("qid", "note_id", "score"), k.rare_depth)), "pool")
        cov, prox = together(lambda: keep(lanes.coverage(q, pool, self.corpus, self.priors), "coverage"), lambda: keep(lanes.proximity(q, pool, self.terms), "proximity"))
        ts = lanes.ts_match(q, pool, self.terms, prox, self.priors)
        adj, back = self.links
        seeds = fusion.rrf({"title": title, "bm25": bm}, fusion.lane_weights(k.topical), 10)
        temporal_q = questions.where(tx.is_temporal(F.col("question"))).select("qid")
        tq = q.join(temporal_q, "qid", "left_semi")
        entity = lanes.entity_fuzzy(q, ix.entity_vocabulary(self.corpus).join(ids, "path").select("note_id", "name"), self.stats)
        ranked = {"title": title, "bm25": bm, "rare": rare, "coverage": lanes.ranked(cov, k.lane_depth), "proximity": lanes.ranked(prox, k.lane_depth), "tsmatch": lanes.ranked(ts, k.lane_depth), "graph": lanes.ranked(lanes.spread(seeds, adj, back), k.lane_depth), "entity": lanes.ranked(entity, k.entity_depth), "time": lanes.ranked(lanes.time_lane(tq, self.postings, self.dates), 30), "title_recency": lanes.ranked(lanes.title_recency(tq, self.corpus, self.dates), 20)}
        near = None
        if vectors is not None and self.chunks is not None:
            near = keep(lanes.ranked(lanes.semantic(vectors, self.chunks.select("note_id", "vec")).join(ids, "note_id", "left_semi"), k.lane_depth), "semantic")
            ranked["semantic"] = near
        nav = known.where((F.col("nth") == 1) & (F.greatest("cover", "cover_idf") >= k.navigational_cover)).select("qid", F.lit(True).alias("nav"))
        every = None
        for name, lane in ranked.items():
            part = lane.select("qid", "note_id", "rank", F.lit(name).alias("lane"))
            every = part if every is None else every.unionByName(part)
        w = F.when(F.coalesce("nav", F.lit(False)), fusion.lane_weights(k.navigational)).otherwise(fusion.lane_weights(k.topical))
        fused = every.join(nav, "qid", "left").withColumn("w", w).groupBy("qid", "note_id").agg(F.sum(F.col("w") / (k.rrf_k + F.col("rank"))).alias("score"))
        fused = keep(lanes.ranked(fused, 20).select("qid", "note_id", F.col("score").alias("rrf")), "fused")
        today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        fresh = fusion.recency_boost(fused, self.dates, fusion.word_hits(q, fused, self.terms), temporal_q, today)
        asked = questions.select("qid", tx.is_episodic(F.col("question")).alias("episodic")).join(fusion.content_words(questions, q), "qid")
        scaled = keep(fusion.rescale(fresh, ids, asked).where(~F.col("path").startswith("System/")), "scaled")
        pins = fusion.rare_pins(q, self.postings, self.priors)
        for more in (delivery.pair_pins(q, self.postings, self.terms, self.priors), delivery.category_pins(q, temporal_q, self.corpus, self.dates), fusion.title_subset_pins(q, self.terms, self.lengths), delivery.entity_pins(entity), fusion.known_pins(known)):
            pins = pins.unionByName(more)
        order = fusion.splice(scaled, pins)
        last = order.join(ids, "note_id").join(scaled.select("qid", "note_id", "score"), ["qid", "note_id"], "left").select("qid", "note_id", "path", "score", "rank")
        answers, unsure = together(lambda: keep(last, "answers"), lambda: keep(fusion.clarify(scaled.join(temporal_q, "qid", "left_anti"), known), "unsure"))
        rescue = None if near is None else delivery.confirmed(answers, near, self.chunks, self.corpus)
        outcomes = fusion.gate(fusion.absent_mass(q), cov, rescue)
        # questions without any term have no row yet
        outcomes = questions.select("qid").join(outcomes, "qid", "left").select("qid", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("gate_cover", F.lit(0.0)).alias("gate_cover"), F.coalesce("absent", F.lit(0.0)).alias("absent"), F.when(F.col("found").isNull(), "the question has no words").otherwise(F.col("reason")).alias("reason"))
        noise = fusion.scattered(unsure, outcomes, q, self.terms).withColumn("noise", F.lit(True))
        person = delivery.relationship_check(questions, answers, self.corpus).where("not honest").select("qid", F.lit(True).alias("person"))
        choice = unsure.select("qid", "options").unionByName(delivery.sibling_clarify(q, known, self.corpus).select("qid", "options"))
        x = outcomes.join(noise, "qid", "left").join(person, "qid", "left").join(choice, "qid", "left")
        bad, role = F.coalesce("noise", F.lit(False)), F.coalesce("person", F.lit(False))
        reason = F.when(F.col("found") & bad, "only weak scattered matches").when(F.col("found") & role, "the question is about a person, the closest note is not").otherwise(F.col("reason"))
        found = F.col("found") & ~bad & ~role
        outcomes = x.select("qid", found.alias("found"), "gate_cover", "absent", reason.alias("reason"), F.when(found & F.col("options").isNotNull(), F.col("options")).otherwise(F.array().cast(unsure.schema["options"].dataType)).alias("clarify"))
        return answers, keep(outcomes, "outcomes"), q

    def search(self, questions: DataFrame, limit: int = 20) -> DataFrame:
        q = self.question_terms(questions)
        return lanes.search(questions, self.corpus, q, self.postings, limit)

    def excerpts(self, questions: DataFrame, answers: DataFrame, results: int = 5, chars: int = 14_000, sections: int = 3) -> DataFrame:
        """(qid, rank, nth, note_id, section): the best sections of the answers within a budget of characters."""
        q = self.question_terms(questions)
        top = self._keep(answers.where(F.col("rank") <= results), "top-answers")
        best = self._keep(delivery.best_sections(q, top.select("qid", "note_id"), self.corpus, sections), "best-sections")
        # a short section that only points to another note is followed by that note's best one
        led = delivery.pointers(best.where("nth = 1"), graph.name_map(self.corpus))
        aims = led.join(self.corpus.select(F.col("path").alias("target"), F.col("note_id").alias("aim")), "target").where("aim != note_id").select("qid", "note_id", "aim")
        there = delivery.best_sections(q, aims.select("qid", F.col("aim").alias("note_id")).distinct(), self.corpus, 1)
        more = aims.join(there.select("qid", F.col("note_id").alias("aim"), "score", "section"), ["qid", "aim"]).select("qid", "note_id", F.lit(sections + 1).alias("nth"), "score", "section")
        return delivery.deliver(top, best.unionByName(more), results, chars)

    def context(self, answers: DataFrame, hops: int = 3, cap: int = 15) -> DataFrame:
        """(qid, path, hops): the neighbourhood of each question's first answer."""
        return graph.neighbourhood(answers.where("rank = 1").select("qid", "path"), graph.adjacency(self.edges), hops, cap)

    def recent(self, question: str, now: str, days: int | None = None, limit: int | None = 40) -> DataFrame:
        """What happened in the period a question names, or in the last `days`, on the question's topic; now is a date. A question
        without a period raises ValueError."""
        today = F.lit(now).cast("date")
        p = temporal.period(F.lit(question), today) if days is None else F.struct(F.date_sub(today, days).alias("from"), F.date_add(today, 1).alias("to"))
        row = self.spark.range(1).select(p.alias("p"), temporal.topic_words(F.lit(question)).alias("topic")).first()
        if row.p is None:
            raise ValueError("no time window in the question; recall looks for topics, days sets a window")
        return temporal.recent(self.corpus, str(row.p["from"]), str(row.p["to"]), row.topic, limit, now=now)

    def gather(self, questions: DataFrame, limit: int = 25) -> DataFrame:
        """(qid, note_id, rank, date, excerpt) of a plain search with content dates."""
        body = self.corpus.select("note_id", F.substring(F.regexp_replace("body", r"\s+", " "), 1, 480).alias("excerpt"))
        return self.search(questions, limit).join(self.dates, "note_id", "left").join(body, "note_id").select("qid", "note_id", "rank", "date", "excerpt")

    def list_notes(self, prefix: str = "", limit: int = 50) -> DataFrame:
        return structure.newest(self.corpus, prefix, limit)

    def read_note(self, path: str) -> DataFrame:
        return self.corpus.where(F.col("path") == path)

    def fetch_document(self, prefix: str, chars: int = 60_000) -> DataFrame:
        return structure.folder_document(self.corpus, prefix, min(chars, 400_000))

    def skills(self) -> DataFrame:
        return structure.skills(self.corpus)

    def resolve(self, names: DataFrame) -> DataFrame:
        """(name, path): the note a name means; null if none."""
        return names.withColumn("k", F.lower(F.trim("name"))).join(graph.name_map(self.corpus).select(F.col("name").alias("k"), "path"), "k", "left").select("name", "path")

    def related(self) -> DataFrame:
        ids = self.corpus.select("note_id", "path")
        by_link = graph.link_relatedness(graph.adjacency(self.edges))
        top = graph.top_terms(self.postings, self.doc_freq, self.stats)
        text = graph.text_relatedness(top).join(ids.select(F.col("note_id").alias("a"), F.col("path").alias("pa")), "a").join(ids.select(F.col("note_id").alias("b"), F.col("path").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "score")
        return graph.fuse_relatedness(by_link, text)

    def check(self, attachments: DataFrame | None = None) -> DataFrame:
        return audit.audit(self.corpus, self.edges, attachments)

    def glossary(self) -> DataFrame:
        return structure.glossary(self.corpus, ix.entity_vocabulary(self.corpus))

    def map(self) -> DataFrame:
        return structure.vault_map(self.corpus, audit.hubs(self.corpus))

    def overview(self) -> DataFrame:
        chunks = self.chunks if self.chunks is not None else self.corpus.where("false")
        return structure.overview(self.corpus, self.edges, chunks)

    def suggest_links(self) -> DataFrame:
        return linking.suggest(self._keep(linking.mentions(self.corpus, linking.patterns(self.corpus)), "mentions"), self.corpus)

    def cleanup(self) -> DataFrame:
        return linking.cleanup_plan(self.corpus)

    def write(self, notes: DataFrame, writes: DataFrame, today: str) -> DataFrame:
        return history.upsert(notes, writes, today)
