"""Documents made of a graph, chunks of a corpus, character n-grams, TF-IDF and names in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import terms as X
from loomgraph.operators.prefix import ordinals, prefix_sums
from loomgraph.operators.runs import longest_run
from loomgraph.operators.views import definitions, labels
from loomgraph.plans.materialize import settled
from loomgraph.plans.spread import shares, spread


def entity_documents(triples: DataFrame, vocabulary: X.Vocabulary) -> DataFrame:
    """(s, key, text) for each IRI subject below the base: a headline, the definition and a line for each fact, sorted by
    predicate and object. Labels, definitions, blank nodes and the meta classes are left out."""
    name = labels(triples, vocabulary)
    own = triples.where((F.col("s_kind") == "iri") & F.col("s").startswith(vocabulary.base))
    facts = own.where(~F.col("p").isin(X.LABEL, X.DEFINITION) & (F.col("o_kind") != "bnode") & ~((F.col("o_kind") == "iri") & F.col("o").isin(X.CLASS, X.OBJECT_PROPERTY, X.DATATYPE_PROPERTY, X.ONTOLOGY)))
    facts = facts.join(name.select(F.col("node").alias("p"), F.col("label").alias("pl")), "p").join(name.select(F.col("node").alias("o"), F.col("label").alias("ol")), "o", "left")
    value = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(F.coalesce("ol", "o"))
    line = F.concat(F.lit("- "), F.col("pl"), F.lit(": "), value)
    lines = facts.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "o", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    key = X.qname(F.col("s"), vocabulary.known())
    head = F.concat(F.lit("## "), F.col("label"), F.lit(" ("), F.col("key"), F.lit(")"))
    heads = own.select("s").distinct().join(name.select(F.col("node").alias("s"), "label"), "s").join(definitions(triples), "s", "left").join(lines, "s", "left").withColumn("key", key)
    first = F.when(F.col("definition").isNotNull(), F.array(F.concat(F.lit("정의: "), F.col("definition"))))
    none = F.array().cast("array<string>")
    return heads.select("s", "key", F.array_join(F.concat(F.array(head), F.coalesce(first, none), F.coalesce("lines", none)), "\n").alias("text"))


def relation_documents(documents: DataFrame) -> DataFrame:
    """(s, line, text): a sentence for each fact or definition line of an entity's document (s, text).

    Further lines of a value that is written over several are lost, unless they begin like a fact.
    """
    lines = documents.select("s", F.posexplode(F.split("text", "\n")).alias("line", "x"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"))
    subject = F.when(F.col("head").startswith("## "), F.regexp_extract("head", r"^## (.*) \(", 1)).otherwise(F.col("head"))
    return lines.where("line > 0 AND (startswith(x, '- ') OR startswith(x, '정의: '))").select("s", "line", F.concat(subject, F.lit(" — "), F.when(F.col("x").startswith("- "), F.substr("x", F.lit(3))).otherwise(F.col("x"))).alias("text"))


def chunks(documents: DataFrame, order: str, text: str = "text", size: int = 400, overlap: int = 80) -> DataFrame:
    """(chunk, text): windows of `size` characters, each `size - overlap` after the last, over all texts joined by blank
    lines in the order of a number column.

    The joined text is never built: a document's offset is a sum over those before it, it gives its part to each window
    that it touches, and a window puts its parts together.
    """
    step = size - overlap
    d = documents.select(F.col(order).cast("long").alias("i"), (F.coalesce(F.col(text), F.lit(""))).alias("t"))
    high = d.agg(F.max("i")).first()[0]
    if high is None:
        return d.select(F.lit(0).cast("long").alias("chunk"), F.col("t").alias("text")).limit(0)
    placed = prefix_sums(d, ["i"], F.length("t") + 2, "at")
    body = placed.select("at", F.when(F.col("i") == high, F.col("t")).otherwise(F.concat("t", F.lit("\n\n"))).alias("t"))
    last = F.col("at") + F.length("t") - 1
    first_chunk = F.greatest(F.lit(0), F.ceil((F.col("at") - (size - 1)) / step))
    parts = body.where(F.length("t") > 0).select("at", "t", F.explode(F.sequence(first_chunk, F.floor(last / step))).alias("chunk"))
    begin = F.greatest(F.col("chunk") * step - F.col("at"), F.lit(0))
    stop = F.least(F.col("chunk") * step + size - F.col("at"), F.length("t"))
    cut = parts.select("chunk", "at", F.substring(F.col("t"), (begin + 1).cast("int"), (stop - begin).cast("int")).alias("part"))
    return cut.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("text"))


def ngrams(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """An array of all character n-grams of the text in lower case, repeats included."""
    a = F.split(F.lower(text), "")
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(0), F.size(a) - n), lambda i: F.array_join(F.slice(a, i + 1, n), ""))).otherwise(none)

    out = F.concat(*[of(n) for n in sizes])
    return F.when(F.length(text) > 0, out).otherwise(F.array().cast("array<string>"))


def term_frequencies(docs: DataFrame, key: str, text: str = "text", sizes: tuple[int, ...] = (2, 3), rows: int = 0) -> DataFrame:
    """(key, gram, tf). rows: how many grams there are at most, where that is known; texts are then dealt by their keys, and a
    task counts those of its share of the texts."""
    return spread(docs, rows, key).select(key, F.explode(ngrams(F.col(text), sizes)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


#: Documents in a block of an index, heaviest grams by which documents are ordered, and questions that are held together
#: against a block.
BLOCK, TOPS, SALTED = 64, 8, 1024
#: Distinct grams up to which each task gets them all: some tens of MB.
GRAMS = 1 << 20


class TfIdf:
    """An index of documents in blocks: postings (doc, block, gram, w, norm) and, for each block and gram, the greatest share
    of a document's norm that it has there. Weight: tf (ln(N / (1 + df)) + 1), which is above zero for every gram.

    Blocks are ranges of the documents in the order of their heaviest grams, so that a block's bounds are near its documents'
    weights. What is joined and summed for a block lies in one task, with some other blocks and for some of the questions:
    a gram that most documents have is split over its blocks, and no task's sums grow with the documents or the questions.
    """

    def __init__(self, docs: DataFrame, key: str, text: str = "text", sizes: tuple[int, ...] = (2, 3)):
        self.sizes = sizes
        self.n, self.grams = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0)) * len(sizes)).first()
        tf = settled(term_frequencies(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "doc", "text", sizes, self.grams))
        df = tf.groupBy("gram").agg(F.count("*").alias("df"))
        idf = (F.log(F.lit(float(max(1, self.n))) / (F.col("df") + 1)) + 1).alias("idf")
        self.idf = settled(df.select("gram", idf))
        known = F.broadcast(self.idf) if self.idf.count() <= GRAMS else self.idf
        weighted = spread(tf.join(known, "gram").select("doc", "gram", (F.col("tf") * F.col("idf")).alias("w")), self.grams, "doc")
        heaviest = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("w", "gram")), False), 1, TOPS), lambda x: x["gram"])
        placed = ordinals(weighted.groupBy("doc").agg(norm("w").alias("norm"), heaviest.alias("tops")), ["tops", "doc"], "place", self.n)
        blocks = placed.select("doc", "norm", F.floor((F.col("place") - 1) / BLOCK).alias("block"))
        self.postings = settled(spread(weighted.join(blocks, "doc").select("doc", "block", "gram", "w", "norm"), self.grams, "block"))
        self.bounds = spread(self.postings, self.grams, "block").groupBy("block", "gram").agg(F.max(F.col("w") / F.col("norm")).alias("high"))

    def top(self, questions: DataFrame, key: str, text: str = "text", k: int = 5, decimals: int | None = None) -> DataFrame:
        """(key, doc, score, rank) of the k best documents of each question with a positive score; ties by doc.

        A question's norm counts grams that no document has. Each question is first scored against the block that can
        reach most; its k-th best score there is a floor, and of the other blocks only those whose bounds reach it are
        scored. The rows are those of scoring every document.
        """
        best = self._ranked(self.scored(questions, key, text, k, decimals), k)
        return best.select(F.col("q").alias(key), "doc", "score", "rank")

    def scored(self, questions: DataFrame, key: str, text: str = "text", k: int = 5, decimals: int | None = None) -> DataFrame:
        """(q, doc, score): every pair that top() has to look at."""
        unseen = F.log(F.lit(float(max(1, self.n)))) + 1
        q = term_frequencies(questions.select(F.col(key).alias("q"), F.col(text).alias("text")), "q", "text", self.sizes)
        weight = F.col("tf") * F.coalesce("idf", unseen)
        weights = settled(q.join(self.idf, "gram", "left").select("q", "gram", F.col("idf").isNotNull().alias("known"), weight.alias("qw")))
        q_norm = weights.groupBy("q").agg(norm("qw").alias("q_norm"))
        known = settled(weights.where("known").join(q_norm, "q").select("q", "gram", "qw", "q_norm"))
        n_asked = known.select("q").distinct().count()
        # What is dealt by cells or blocks is joined by them and the gram without being dealt again.
        known.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", False)
        # A cell of some blocks and some questions is summed in one task: the questions' grams go to each group of blocks.
        blocks = -(-self.n // BLOCK)
        parts = max(1, -(-n_asked // SALTED))
        groups = 4 * shares(blocks * min(n_asked, SALTED))  # some to a task, so that tasks are alike
        part = F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        cells = blocks * n_asked
        asked = spread(known.select("*", part).withColumn("group", every(groups)), cells, "group", "part")
        bounds = spread(self.bounds.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", every(parts)), cells, "group", "part")
        met = asked.join(bounds, ["group", "part", "gram"]).groupBy("q", "q_norm", "block", "group", "part").agg(F.sum(F.col("qw") * F.col("high")).alias("reach"))
        reach = settled(met.select("q", "block", "part", "q_norm", (F.col("reach") / F.col("q_norm")).alias("reach")))
        postings = self.postings.withColumn("part", every(parts))

        def of(wanted: DataFrame) -> DataFrame:
            wanted = settled(wanted.select("q", "block", "part", "q_norm"))
            most_rows = max(wanted.count() * BLOCK, self.grams * parts)  # pairs to sum, or postings to sort
            pairs = spread(wanted, most_rows, "block", "part").join(known.select("q", "gram", "qw"), "q")
            pairs = pairs.join(spread(postings, most_rows, "block", "part"), ["block", "part", "gram"])
            dots = pairs.groupBy("q", "doc", "q_norm", "norm", "block", "part").agg(F.sum(F.col("qw") * F.col("w")).alias("dot")).where("dot > 0")
            score = F.col("dot") / (F.col("q_norm") * F.col("norm"))
            return dots.select("q", "doc", (score if decimals is None else F.round(score, decimals)).alias("score"))

        most = reach.groupBy("q").agg(F.max(F.struct("reach", "block"))["block"].alias("most"))
        near = reach.join(most, "q")
        first = settled(of(near.where("block = most")))
        floor = self._ranked(first, k).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        slack = 1e-9 if decimals is None else 10.0**-decimals
        rest = near.where("block <> most").join(floor, "q", "left").where(F.col("floor").isNull() | (F.col("reach") + slack >= F.col("floor")))
        return first.unionByName(of(rest))

    def _ranked(self, scored: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def norm(w: str) -> Column:
    n = F.sqrt(F.sum(F.col(w) * F.col(w)))
    return F.when(n == 0, 1.0).otherwise(n)


def name_index(triples: DataFrame, vocabulary: X.Vocabulary) -> DataFrame:
    """(name, node): labels and names of nodes below the base, and of 'long form(short form)' both parts, if of two or
    more characters."""
    named = triples.where(F.col("p").isin(X.LABEL, *vocabulary.names) & (F.col("s_kind") == "iri") & F.col("s").startswith(vocabulary.base))
    return with_aliases(named.select(F.col("o").alias("name"), F.col("s").alias("node")))


def with_aliases(names: DataFrame) -> DataFrame:
    inner = F.regexp_replace("name", r"\)+$", "")
    both = F.when(F.contains("name", F.lit("(")) & F.col("name").endswith(")"), F.filter(F.array(F.trim(F.substring_index(inner, "(", 1)), F.trim(F.substr(inner, F.instr(inner, "(") + 1))), lambda x: F.length(x) >= 2))
    return names.select(F.explode(F.concat(F.array("name"), F.coalesce(both, F.array().cast("array<string>")))).alias("name"), "node").distinct()


#: Characters in a row that a longer name shares with a question, names above which a gram is common, and names to a salt.
RUN, COMMON, DEALT = 4, 256, 4096


def _stretch(flags: str) -> Column:
    """Characters in the longest stretch of grams marked 1, in a text of 0 and 1; none: 0."""
    most = F.array_max(F.transform(F.split(flags, "0"), F.length))
    return F.when(most > 0, most + RUN - 1).otherwise(0)


def _placed_grams(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, g): the grams of RUN characters at every place of the texts in that column."""
    return texts.select(key, F.posexplode(ngrams(F.col(key), (RUN,))).alias("at", "g"))


def match(names: DataFrame, questions: DataFrame, limit: int = 8, shortest: int = 1) -> DataFrame:
    """(qid, node, score, lcs, rank): the nodes that a question names, best first.

    names: (name, node); questions: (qid, question). Case doesn't count. A name of under four characters matches if
    the question contains it (score 1); a longer one if they share four characters in a row, its score being the
    longest shared run over its length. A node has its best name; order: score, length of the run, node.

    Pairs come from equi-joins on grams (whole short names, four characters of long ones), never from all pairs. Those that
    share a gram of few names are scored first, and a question's limit-th best score is then a floor. A run shared by the
    rest lies within a stretch of common grams in the name and one in the question; pairs whose shorter stretch
    can't reach the floor are left out in the join, where common grams are dealt to salts. No row is lost by that.
    """
    n = names.select(F.lower("name").alias("n"), "node").where(F.length("n") >= shortest).distinct()
    q = questions.select("qid", F.lower("question").alias("q"))
    few = n.where(F.length("n") < RUN)
    parts = q.select("qid", F.explode(F.array_distinct(ngrams(F.col("q"), tuple(range(1, RUN))))).alias("n"))
    contained = parts.join(few, "n").select("qid", "node", F.lit(1.0).alias("score"), F.length("n").alias("lcs"))

    texts = n.where(F.length("n") >= RUN).select("n").distinct()
    offered, asked = _placed_grams(texts, "n"), _placed_grams(q.select("q").distinct(), "q")
    known = settled(offered.select("n", "g").distinct().groupBy("g").agg(F.count("*").alias("df")))
    is_common = F.when(F.col("df") > COMMON, "1").otherwise("0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", is_common.alias("f")))), lambda x: x["f"]), "")

    def posted(grams: DataFrame, key: str) -> DataFrame:
        flat = grams.join(known, "g", "left")
        return settled(flat.groupBy(key).agg(joined.alias("flags"), F.collect_set(F.when(F.col("df").isNotNull(), F.struct("g", "df"))).alias("grams")).withColumn("stretch", _stretch("flags")))

    by_name, by_question = posted(offered, "n"), posted(asked, "q")
    take = lambda d, key, test: d.select(key, "stretch", F.explode("grams").alias("x")).select(key, "stretch", "x.g", "x.df").where(test)

    def compared(pairs: DataFrame) -> DataFrame:
        run = longest_run(F.col("n"), F.col("q"))
        told = pairs.select("n", "q").distinct().withColumn("lcs", run).withColumn("score", F.col("lcs") / F.length("n"))
        return told.join(q, "q").join(n, "n").select("qid", "node", "score", "lcs")

    rare = F.col("df") <= COMMON
    first = settled(compared(take(by_name, "n", rare).select("n", "g").join(take(by_question, "q", rare).select("q", "g"), "g")).unionByName(contained))
    floor = _best_nodes(first, limit).where(F.col("rank") == limit).select("qid", F.col("score").alias("floor"))
    floors = q.join(floor, "qid", "left").groupBy("q").agg(F.min(F.coalesce("floor", F.lit(0.0))).alias("floor"))
    salts = (F.floor(F.col("df") / DEALT) + 1).cast("int")
    left = take(by_name, "n", ~rare).withColumn("salt", F.pmod(F.xxhash64("n"), salts).cast("int")).select("n", "g", "salt", F.col("stretch").alias("n_stretch"))
    right = take(by_question, "q", ~rare).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("q", "g", "salt", F.col("stretch").alias("q_stretch")).join(floors, "q")
    reach = F.least("n_stretch", "q_stretch") + 1e-6 >= F.col("floor") * F.length("n")
    return _best_nodes(first.unionByName(compared(left.join(right, ["g", "salt"]).where(reach))), limit)


def _best_nodes(scored: DataFrame, limit: int) -> DataFrame:
    best = scored.groupBy("qid", "node").agg(F.max(F.struct("score", "lcs")).alias("b")).select("qid", "node", "b.score", "b.lcs")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("lcs"), "node"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)
