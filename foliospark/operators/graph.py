"""A property graph as two DataFrames: nodes (node_id, label, name, props) and edges (src, dst, rel, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators.relational import cut, latest, top_per_group
from foliospark.tables import Table


def coauthors(writes: DataFrame, paper: str, author: str) -> DataFrame:
    """(a, b, n): authors a < b of common papers, and how many; from distinct (paper, author)."""
    w = writes.select(F.col(paper).alias("p"), F.col(author).alias("x")).distinct()
    a, b = w.withColumnRenamed("x", "a"), w.withColumnRenamed("x", "b")
    return a.join(b, "p").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back.where("src <> dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges out plus edges in."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def backbone(papers: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of lecturers, programmes, papers, years, journals and keywords.

    papers: title, year, journal, authors, author_ids, keywords, doi, link, abstract, tldr. people: id, name, unit. Authors
    that aren't among the people are left out. An author is one person: that of the id, else of those with the name the one with the least key.
    """
    from foliospark.functions.time import year_of

    node = lambda d, key, label, name: d.select(key.alias("node_id"), F.lit(label).alias("label"), name.alias("name")).where("node_id is not null")
    edge = lambda d, s, rel, t: d.select(s.alias("src"), t.alias("dst"), F.lit(rel).alias("rel"))
    slug = lambda c: F.replace(text.plain(c), F.lit(" "), F.lit("_"))
    ppl = people.select(F.concat(F.lit("dosen_"), F.coalesce(F.nullif(F.col("id"), F.lit("")), F.md5("name"))).alias("pid"), "id", "name", "unit", F.lower(F.trim("name")).alias("lname"))
    p = papers.withColumn("node", F.concat(F.lit("paper_"), text.md5_prefix(F.col("title")))).where(F.length(F.coalesce("title", F.lit(""))) > 0)
    y = p.withColumn("y", year_of(F.col("year"))).where("y is not null")
    j = p.where(F.trim(F.coalesce("journal", F.lit(""))) != "")
    k = p.select("node", F.explode(F.array_distinct(text.parts(F.lower("keywords"), "[;,]"))).alias("k")).where(F.length("k") > 2)
    a = p.select("node", text.parts(F.col("authors"), ";").alias("an"), F.transform(F.split(F.coalesce("author_ids", F.lit("")), ";"), lambda x: F.trim(x)).alias("ai"))
    a = a.select("node", F.posexplode("an").alias("at", "author"), "ai").select("node", "at", F.lower("author").alias("lname"), F.coalesce(F.get("ai", F.col("at")), F.lit("")).alias("aid"))
    # authors are read once: their places in lists that a shuffle made may be others when they are read again
    ids = ppl.where("id <> ''").select(F.col("pid").alias("of_id"), F.col("id").alias("aid")).distinct()
    bearers = ppl.groupBy("lname").agg(F.min("pid").alias("of_name"))
    w = a.join(ids, "aid", "left").join(bearers, "lname", "left").select("node", F.coalesce("of_id", "of_name").alias("pid")).where("pid is not null")
    unit = ppl.where(F.trim(F.coalesce("unit", F.lit(""))) != "")
    nodes = [
        node(ppl, F.col("pid"), "Dosen", F.col("name")), node(unit, F.concat(F.lit("prodi_"), slug(F.col("unit"))), "ProgramStudi", F.col("unit")),
        node(p, F.col("node"), "Paper", F.col("title")), node(y, F.concat(F.lit("year_"), F.col("y").cast("string")), "Year", F.col("y").cast("string")),
        node(j, F.concat(F.lit("journal_"), text.md5_prefix(F.col("journal"))), "Journal", F.col("journal")), node(k, F.concat(F.lit("keyword_"), text.md5_prefix(F.col("k"))), "Keyword", F.col("k")),
    ]
    edges = [
        edge(unit, F.col("pid"), "MEMBER_OF", F.concat(F.lit("prodi_"), slug(F.col("unit")))), edge(y, F.col("node"), "PUBLISHED_YEAR", F.concat(F.lit("year_"), F.col("y").cast("string"))),
        edge(j, F.col("node"), "PUBLISHED_IN", F.concat(F.lit("journal_"), text.md5_prefix(F.col("journal")))), edge(k, F.col("node"), "HAS_KEYWORD", F.concat(F.lit("keyword_"), text.md5_prefix(F.col("k")))),
        edge(w, F.col("pid"), "WRITES", F.col("node")),
    ]
    from functools import reduce

    all_nodes = reduce(DataFrame.unionByName, nodes).groupBy("node_id").agg(F.min(F.struct("label", "name")).alias("n")).select("node_id", "n.*")
    return all_nodes, reduce(DataFrame.unionByName, edges).distinct()


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids, edges.src == ids.node_id, "left_semi").join(ids, edges.dst == ids.node_id, "left_semi")


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The last of each (label, node_id), its properties as text without empty ones."""
    props = F.map_filter("props", lambda k, v: v.isNotNull() & ~F.lower(v).isin("", "nan"))
    return latest(nodes, ["label", "node_id"], [order]).withColumn("props", props)


def merge_edges(edges: DataFrame, nodes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Merged edges (the last of each src, rel, dst), and (total, kept, skipped)."""
    good = valid_edges(edges, nodes)
    total, kept = edges.agg(F.count(F.lit(1)).alias("total")), good.agg(F.count(F.lit(1)).alias("kept"))
    return latest(good, ["src", "rel", "dst"], [order]), total.join(kept).withColumn("skipped", F.col("total") - F.col("kept"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """What breaks the uniqueness of (label, node_id)."""
    return nodes.groupBy("label", "node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of parsed triples (pos, h, h_props, r, r_props, t, t_props); later properties override, incomplete ones go."""
    good = triples.where("h <> '' and r <> '' and t <> ''")
    ends = good.select((F.col("pos") * 2).alias("pos"), F.col("h").alias("name"), F.col("h_props").alias("p")).unionByName(good.select((F.col("pos") * 2 + 1).alias("pos"), F.col("t").alias("name"), F.col("t_props").alias("p")))

    def folded(df: DataFrame, keys: list[str]) -> DataFrame:
        flat = df.select(*keys, "pos", F.explode_outer("p").alias("k", "v"))
        last = flat.groupBy(*keys, "k").agg(F.max_by("v", "pos").alias("v"))
        pairs = F.filter(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e.k.isNotNull())
        return last.groupBy(*keys).agg(F.map_from_entries(pairs).alias("props"))

    return folded(ends, ["name"]), folded(good.select("pos", "h", F.col("r").alias("rel"), "t", F.col("r_props").alias("p")), ["h", "rel", "t"])


def _without(props, key: str):
    return F.map_filter(props, lambda k, v: k != key)


def parse_triples(lines: DataFrame) -> DataFrame:
    """(pos, h, h_props, r, r_props, t, t_props) from JSON lines whose ends are texts or objects with name (relation: type)."""
    out = [F.col("pos")]
    for part, key in (("h", "name"), ("r", "type"), ("t", "name")):
        raw = F.get_json_object("value", f"$.{part}")
        props = F.from_json(raw, "map<string,string>")
        is_object = raw.startswith("{")
        out.append(F.coalesce(F.when(is_object, F.element_at(props, key)).otherwise(raw), F.lit("")).alias(part))
        out.append(F.when(is_object & props.isNotNull(), _without(props, key)).otherwise(F.create_map().cast("map<string,string>")).alias(f"{part}_props"))
    return lines.where(F.try_parse_json("value").isNotNull()).select(*out)


def delete_entity(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = names.select(F.col("name").alias("g"))
    return nodes.join(gone, nodes.name == gone.g, "left_anti"), edges.join(gone, edges.src == gone.g, "left_anti").join(gone, edges.dst == gone.g, "left_anti")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes and edges in all, by label and by relation; edges also counted from both ends."""
    n = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    e = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(2)).alias("n2"))
    total = lambda d, kind, c: d.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("name"), "n")
    return n.unionByName(e.select(F.lit("rel").alias("kind"), F.col("rel").alias("name"), "n")).unionByName(total(n, "nodes", "n")).unionByName(total(e, "edges", "n")).unionByName(total(e, "edges_undirected", "n2"))


def hop_triples(edges: DataFrame, seeds: DataFrame, limit: int = 100) -> DataFrame:
    """(h, r, t) one and two steps out of the seeds, and one and two steps in; directions aren't mixed along a way."""
    s = seeds.select(F.col("node").alias("n")).distinct()
    e = edges.select("src", "rel", "dst").distinct()
    out1 = e.join(s, e.src == s.n, "left_semi")
    in1 = e.join(s, e.dst == s.n, "left_semi")
    out2 = e.join(out1.select(F.col("dst").alias("m")).distinct(), F.col("src") == F.col("m"), "left_semi")
    in2 = e.join(in1.select(F.col("src").alias("m")).distinct(), F.col("dst") == F.col("m"), "left_semi")
    all_ = out1.unionByName(out2).unionByName(in1).unionByName(in2).distinct().select(F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t"))
    return all_.orderBy("h", "r", "t").limit(limit)


def sample_subgraph(nodes: DataFrame, edges: DataFrame, n: int, seeds: int = 5, second: int = 5) -> tuple[DataFrame, DataFrame]:
    """About n connected nodes: the most linked ones, some neighbours of each, some of theirs; filled up with unlinked nodes.

    Returns node ids and the edges among them. Ties go by id.
    """
    deg = degrees(edges)
    top = deg.orderBy(F.desc("degree"), "node").limit(seeds).select("node")
    und = cut(undirected(edges.select("src", "dst")).distinct())

    def around(of: DataFrame, k: int) -> DataFrame:
        near = und.join(of.withColumnRenamed("node", "src"), "src").join(deg.withColumnRenamed("node", "dst"), "dst")
        return top_per_group(near, ["src"], [F.desc("degree"), F.col("dst")], k).select(F.col("dst").alias("node")).distinct()

    first = around(top, max(1, int(0.15 * n)))
    two = around(first, second)
    ranked = top.withColumn("g", F.lit(0)).unionByName(first.withColumn("g", F.lit(1))).unionByName(two.withColumn("g", F.lit(2))).groupBy("node").agg(F.min("g").alias("g"))
    alone = nodes.select(F.col("node_id").alias("node")).join(ranked, "node", "left_anti").orderBy("node").limit(n).withColumn("g", F.lit(3))
    chosen = ranked.unionByName(alone).orderBy("g", "node").limit(n).select(F.col("node").alias("node_id"))
    return chosen, valid_edges(edges, chosen)


def keyword_neighbourhood(nodes: DataFrame, edges: DataFrame, keyword: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes whose name has the keyword and their neighbours, ``most`` at most, and the edges among them."""
    seeds = nodes.where(F.contains(F.lower("name"), F.lower(F.lit(keyword)))).select("node_id").orderBy("node_id").limit(most)
    near = undirected(edges.select("src", "dst")).join(seeds, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id"))
    kept = seeds.withColumn("g", F.lit(0)).unionByName(near.distinct().withColumn("g", F.lit(1))).groupBy("node_id").agg(F.min("g").alias("g")).orderBy("g", "node_id").limit(most).select("node_id")
    return kept, valid_edges(edges, kept)


def paths(edges: DataFrame, seeds: DataFrame, hops: int = 2, per_seed: int = 20) -> DataFrame:
    """(seed, path array): ways of 1 to ``hops`` edges in any direction, no edge twice, the first ``per_seed`` of each seed."""
    e = edges.select("src", "dst", "rel").distinct().withColumn("eid", F.concat_ws("␟", "src", "rel", "dst"))
    und = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel", "eid").unionByName(e.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel", "eid"))
    now = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array(F.col("node").cast("string")).alias("path"), F.array().cast("array<string>").alias("used"))
    found = None
    for _ in range(hops):
        now = now.join(und, (F.col("at") == F.col("a")) & ~F.array_contains("used", F.col("eid"))).select("seed", F.col("b").alias("at"), F.concat("path", F.array("rel", F.col("b").cast("string"))).alias("path"), F.concat("used", F.array("eid")).alias("used"))
        step = top_per_group(now, ["seed"], [F.size("path").asc(), F.col("path").asc()], per_seed)
        found = step if found is None else found.unionByName(step)
    return top_per_group(found, ["seed"], [F.size("path").asc(), F.col("path").asc()], per_seed).select("seed", "path")


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20) -> DataFrame:
    """(node, rank) by power iteration over src -> dst with equal weights; nodes without out-edges spread evenly.

    A round joins edges with ranks and sums by target, partly before the shuffle; a hub's edges stay single rows, so that a
    skewed join can be split. Each round's ranks are written, since the next one reads them twice.
    """
    e = cut(edges.select("src", "dst").distinct())
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    rank = cut(nodes.join(out, F.col("node") == F.col("src"), "left").select("node", "k", F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        share = rank.where("k is not null").select(F.col("node").alias("src"), (F.col("rank") / F.col("k")).alias("r"))
        got = e.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("r").alias("r"))
        rank = cut(rank.select("node", "k").join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "k", ((1 - alpha) / n + alpha * (F.coalesce("r", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return rank.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): every node takes its neighbours' most frequent label, the least of equally frequent ones.

    At first all labels differ, so a node takes its least neighbour's: that round needs no votes, which would be as many as edges.
    """
    und = Table(undirected(edges.select("src", "dst")).distinct())
    if not rounds:
        return und.df.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    labels = Table(und.df.where("dst is not null").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")).where("node is not null"))
    for _ in range(rounds - 1):
        votes = und.df.join(labels.df.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        after = Table(votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).select(F.col("src").alias("node"), "label"))
        labels.drop()
        labels = after
    und.drop()
    return labels.df.withColumnRenamed("label", "community")


def distances(edges: DataFrame, seeds: DataFrame, most: int = 4) -> Table:
    """(seed, node, distance, via): every node that a seed reaches in ``most`` steps of any direction, by the fewest, and the least
    of its neighbours that is one step nearer to the seed.

    All seeds go on at once, a step a round; a round joins the nodes that the last one reached with their edges and drops what was reached before.
    """
    und = Table(undirected(edges.select("src", "dst").where("src is not null and dst is not null")).distinct()).df
    first = seeds.select("node").where("node is not null").distinct()
    reached = Table(first.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.lit(None).cast(first.schema["node"].dataType).alias("via")), {"n": F.count(F.lit(1))})
    found = last = reached.df
    more, step = reached.metrics["n"], 0
    while more and step < most:
        step += 1
        near = last.select("seed", F.col("node").alias("src")).join(und, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        fresh = Table(near.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(step).alias("distance"), "via"), {"n": F.count(F.lit(1))})
        last, more = fresh.df, fresh.metrics["n"]
        found = found.unionByName(last)
    reached.df = found
    return reached


def clue_subgraph(edges: DataFrame, seeds: DataFrame, most: int = 4) -> DataFrame:
    """(a, b, step, src, dst): a shortest way between each two seeds a < b that are ``most`` steps apart at most, edge by edge from b back to a.

    Of ways of the same length the one whose nodes, from b on, are the least. So the graph holds what links the seeds and nothing else.
    """
    known = distances(edges, seeds, most).df
    ends = seeds.select(F.col("node").alias("b")).distinct()
    pairs = known.join(ends, F.col("node") == F.col("b")).where("seed < b")
    now = Table(pairs.select(F.col("seed").alias("a"), "b", F.lit(1).alias("step"), F.col("node").alias("src"), F.col("via").alias("dst"), F.col("distance").alias("left")))
    back = known.select(F.col("seed").alias("a"), F.col("node").alias("dst"), F.col("via").alias("to"))
    ways = now.df
    for step in range(2, most + 1):
        now = Table(now.df.where("left > 1").join(back, ["a", "dst"]).select("a", "b", F.lit(step).alias("step"), F.col("dst").alias("src"), F.col("to").alias("dst"), (F.col("left") - 1).alias("left")))
        ways = ways.unionByName(now.df)
    return ways.drop("left")


def lookback_pairs(tokens: DataFrame, back: int = 3) -> DataFrame:
    """(src, dst, n): words of a sentence that stand at most ``back`` places apart. tokens: sent, pos, node."""
    w = Window.partitionBy("sent").orderBy("pos")
    ahead = tokens.select(F.col("node").alias("src"), F.array(*[F.lead("node", k).over(w) for k in range(1, back + 1)]).alias("ahead"))
    pairs = ahead.select("src", F.explode("ahead").alias("dst"))
    return pairs.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence(tokens: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(src, dst, n): pairs src < dst of one sentence, without those in ``known``."""
    t = tokens.select("sent", "node").distinct()
    pairs = t.withColumnRenamed("node", "src").join(t.withColumnRenamed("node", "dst"), "sent").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs if known is None else pairs.join(known.select("src", "dst"), ["src", "dst"], "left_anti")


def record_triples(records: DataFrame) -> DataFrame:
    """(h, r, t) of publication records: title, authors, keywords, affiliations (by ";"), field."""
    t = F.trim("title")
    of = lambda c, rel: F.transform(text.ordered_set(F.col(c), "[;|]"), lambda x: F.struct(t.alias("h"), F.lit(rel).alias("r"), x.alias("t")))
    both = F.flatten(F.array(of("field", "BELONGS_TO"), of("authors", "AUTHORED_BY"), of("keywords", "HAS_KEYWORD")))
    who = records.where(t != "").select(F.explode(text.ordered_set(F.col("authors"), "[;|]")).alias("h"), F.lit("AFFILIATED_WITH").alias("r"), F.explode_outer(F.array("affiliations")).alias("a")).select("h", "r", F.explode(text.ordered_set(F.col("a"), "[;|]")).alias("t"))
    return records.where(t != "").select(F.inline(both)).unionByName(who).distinct()


def tree_paths(folders: DataFrame) -> DataFrame:
    """(id, path, level) of a tree given by parent_id, from the roots down to its last level."""
    now = out = cut(folders.where("parent_id is null").select("id", F.concat(F.lit("/"), "name").alias("path"), F.lit(0).alias("level")))
    below = folders.where("parent_id is not null").select(F.col("id").alias("c"), "parent_id", "name")
    while now.head(1):
        now = cut(now.join(below, F.col("id") == F.col("parent_id")).select(F.col("c").alias("id"), F.concat_ws("/", "path", "name").alias("path"), (F.col("level") + 1).alias("level")))
        out = out.unionByName(now)
    return out
