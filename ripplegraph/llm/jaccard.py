"""Self-join of documents on the Jaccard similarity of their word shingles, by a token-group matrix.

1. Every text becomes its set of word shingles (64-bit hashes). Blocks of documents and buckets of hashes exchange how
   many blocks' documents hold each shingle. A document of which more than a fifth of the shingles occurs nowhere else
   can't reach the similarity with anything, so it is done.
2. The others are merged by equal sets and partitioned into groups of similar documents: by the smallest hash among
   their shared shingles, large groups being split by a hash. Members of a group are compared within it.
3. The token-group matrix holds, per shingle, the groups whose union has it, with the sizes of the members that have it.
   Only the rarest fifth of a set is kept there (two similar sets must meet in it). A query document is bound by
   the matrix to the groups that its rarest shingles hit in fitting sizes, and only these groups are opened: first
   each shingle's first and last group, for one document per component, which connects large groups of copies; then every
   group let in, for every document, where the group has members of a larger component.

Only comparisons inside a component that is already connected are left out.
"""

from __future__ import annotations

from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm import common
from ripplegraph.llm.common import free_names, quoted
from ripplegraph.llm.components import components
from ripplegraph.plans.skew import is_small
from ripplegraph.session import materialise

BLOCK_BYTES = 8 << 20
# Shingles are about as many as a sixth of the bytes of a text.
BUCKET_BYTES = 16 << 20
GROUP = 1_024
# Asks that one task compares with a group.
OPENED = 2_048
_SETS = "doc_id long, text_key binary, n_shingles long, sig binary, tokens binary, prefix array<long>, least long, splits int"


def _block_tokens(table: pa.Table, width: int) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray]:
    table = common.ordered(table)
    sets = common.word_shingles(common.as_bytes(table["text"]), width)
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *sets]))
    fresh = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return table, sets, every[fresh], np.diff(np.append(fresh, len(every)))


def _judged(ranges: int, width: int, percent: int, nameless: bool):
    """The documents of a block with their set sizes; sets only of those that may have a partner."""

    def judge(docs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            table, sets, tokens, _ = _block_tokens(docs, width)
            classes = common.classes_of(tokens, replies, ranges)
            for doc_id, text, own in zip(table["doc_id"].to_pylist(), common.as_bytes(table["text"]), sets):
                n, text_key = len(own), md5(text).digest()
                need = -(-percent * n // 100)
                rare = classes[np.searchsorted(tokens, own)]
                shared = int((rare > 0).sum())
                if (doc_id is None and not nameless) or n == 0 or shared < need:
                    out.append((doc_id, text_key, n, None, None, None, None, None))
                    continue
                order = np.lexsort((own, rare))[n - shared : n - need + 1]
                least = int(np.flatnonzero(rare > 0)[0])
                splits = 1 << max(0, int(rare[least]) - GROUP.bit_length() + 1)
                sig = blake2b(own.tobytes(), digest_size=16).digest()
                out.append((doc_id, text_key, n, sig, own.tobytes(), own[order].view(np.int64), int(own[least].view(np.int64)), splits))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32()]
        return common.arrow_table(out, list(zip([f.split()[0] for f in _SETS.split(", ")], kinds)))

    return judge


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``percent``."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _labels_in_group(percent: int):
    """Components within one group, named by their smallest node; connected documents aren't compared again."""

    def label(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        clusters: list[list[int]] = []
        for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i])):
            merged, rest = [i], []
            for cluster in clusters:
                if any(similar(sets[j], sets[i], percent) for j in reversed(cluster)):
                    merged = cluster + merged
                else:
                    rest.append(cluster)
            clusters = [*rest, merged]
        grp = table["grp"][0].as_py()
        tops = [min(nodes[i] for i in cluster) for cluster in clusters]
        rows = [(nodes[i], grp, top) for cluster, top in zip(clusters, tops) for i in cluster]
        return common.arrow_table(rows, [("node", pa.binary()), ("grp", pa.int64()), ("component", pa.binary())])

    return label


def _links_to_queries(percent: int):
    """Links between the components of the queries let into one group and those of its members."""

    def link(members: pa.Table, queries: pa.Table) -> pa.Table:
        links = set()
        if members.num_rows and queries.num_rows:
            by: dict[bytes, list[np.ndarray]] = {}
            for own, data in zip(members["component"].to_pylist(), members["tokens"].to_pylist()):
                by.setdefault(own, []).append(np.frombuffer(data, np.uint64))
            for own, data in zip(queries["component"].to_pylist(), queries["tokens"].to_pylist()):
                tokens = np.frombuffer(data, np.uint64)
                for other, inside in by.items():
                    if other != own and (own, other) not in links and any(similar(s, tokens, percent) for s in inside):
                        links.add((own, other))
        return common.arrow_table(sorted(links), [("a", pa.binary()), ("b", pa.binary())])

    return link


def shingle_sets(docs: DataFrame, width: int, percent: int, nameless: bool = False) -> DataFrame:
    """Every document with its number of distinct shingles, and the set itself where a partner is possible.

    Documents without a doc_id take part only with ``nameless``. ``text_key`` is the MD5 digest of the text.
    """
    common.prepare(docs.sparkSession)
    plan = common.exchange(common.text_bytes(docs), BLOCK_BYTES, BUCKET_BYTES)
    dealt = common.in_blocks(docs, plan.blocks)
    replies = common.hash_classes(dealt, lambda table: _block_tokens(table, width)[2:], plan)
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_judged(plan.ranges, width, percent, nameless), _SETS)


def _placed(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of the stored ``sets`` that have a set, with the component that each is in."""
    kept = sets.where("sig is not null")
    # One node for each different set: exact copies are merged before any exchange of sets.
    merged = kept.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n_shingles", "tokens", "prefix", "least", "splits")])
    part = F.pmod(F.xxhash64("sig"), F.col("splits"))
    nodes = materialise(
        merged.select(F.col("sig").alias("node"), F.col("n_shingles").alias("n"), "tokens", "prefix", F.xxhash64("least", part).alias("grp")),
        "nodes",
    )
    in_group = nodes.select("grp", "node", "tokens").groupBy("grp").applyInArrow(_labels_in_group(percent), "node binary, grp long, component binary")
    labels = materialise(in_group, "labels")
    for hub in ("min", "max", None):
        links = materialise(_open_groups(nodes, labels, percent, hub), "links")
        higher = components(links).select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = labels.join(higher, "component", "left").select("node", "grp", F.coalesce("top", "component").alias("component"))
        labels = materialise(labels, "labels")
    return kept.select("doc_id", "text_key", "n_shingles", "sig").join(labels.select(F.col("node").alias("sig"), "component"), "sig")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents with the size of their shingle set and the component of similar documents they belong to.

    ``docs`` has doc_id and text; other columns are ignored. Words lie between ASCII white space, A-Z lower-cased; a
    text with fewer than ``width`` words has all of them as one shingle. Two documents link when
    100 * intersection >= percent * union. The component is named by its smallest doc_id.
    Null and empty texts have no shingles and link with nothing; a null doc_id links with nothing and has no component;
    each of several rows with one doc_id is judged by its own text; an empty table gives no rows.
    """
    sets = materialise(shingle_sets(docs, width, percent), "sets")
    placed = _placed(sets, percent)
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(smallest, "component").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(sets.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component of similar texts.

    Rows are told apart by doc_id and text, never by doc_id alone: rows that share a doc_id are judged each by its own
    text, and rows without a doc_id are linked like others. Of a component the row with the smallest doc_id stays, among equal
    ids that with the smallest digest of its text; a row without a doc_id stays only where no member has one. Of rows
    with the same doc_id and text one stays, any of them. Null and empty texts, and texts without words, all stay.
    """
    sets = materialise(shingle_sets(docs, width, percent, nameless=True), "sets")
    placed = _placed(sets, percent)
    counted = placed.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    member = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "copies")
    counted = materialise(counted.select("component", member.alias("member")), "members")
    first = counted.groupBy("component").agg(F.min("member").alias("first"))
    # all but the first go; of the first too, if it is there several times, to come back once
    told = counted.join(first, "component").withColumn("stays", F.col("member") == F.col("first"))
    told = told.where(~F.col("stays") | (F.col("member.copies") > 1))
    marked = told.select(F.col("member.doc_id").alias("doc_id"), F.lower(F.hex("member.text_key")).alias("text_key"), "stays")
    own_id, own_key, stays = free_names(docs, 3)
    marked = materialise(marked.toDF(own_id, own_key, stays), "marked")
    if is_small(marked):  # rows of some 50 bytes; otherwise the documents meet them in a shuffle
        marked = F.broadcast(marked)
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.md5(F.col("text").cast("binary")) == F.col(own_key))
    rest = docs.join(marked, same, "left_anti")
    once = docs.join(marked.where(stays), same).groupBy(own_id, own_key).agg(F.first(F.struct(*[F.col(quoted(c)) for c in docs.columns])).alias(stays))
    return rest.unionByName(once.select(f"{stays}.*"))


def _qualifying(nodes: DataFrame, labels: DataFrame, percent: int, hub: str | None) -> DataFrame:
    """Who is to ask which group (grp, node, component): what the token-group matrix lets through.

    The matrix has a row per shingle, group and component in it, with the sizes of the members that have the shingle and
    the most shingles that one of them has from there on, in order of rarity: the first common shingle bounds the overlap
    by these. A node asks all such groups of larger components (by documents, then by name; the others ask back).
    With ``hub`` (min or max), one node of each component asks only the first or last group of each shingle, so that
    the groups that share a shingle are connected without pairs of groups.
    """
    mass = labels.groupBy("component").agg(F.count("*").alias("mass"))
    told = labels.join(mass, "component").select("node", "component", "mass")
    rest = F.size("prefix") + F.ceil(F.col("n") * percent / 100) - 1 - F.col("pos")
    held = nodes.select("node", "grp", "n", "prefix").join(told, "node")
    prefixes = held.select("*", F.posexplode("prefix").alias("pos", "token")).select("token", "node", "grp", "n", "component", "mass", rest.alias("rest"))
    matrix = prefixes.groupBy("token", "grp", F.col("component").alias("there"), F.col("mass").alias("weight")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("tail")
    )
    if hub is None:
        queries = prefixes.select("token", "node", "component", "mass", F.col("grp").alias("home"), F.col("n").alias("least"), F.col("n").alias("most"), "rest")
        other = F.struct("mass", "component") < F.struct(F.col("weight").alias("mass"), F.col("there").alias("component"))
    else:
        one = F.struct("grp", "there", "low", "high", "tail")
        matrix = matrix.groupBy("token").agg(getattr(F, hub)(one).alias("one")).select("token", "one.*")
        whole = [F.min("node").alias("node"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest")]
        queries = prefixes.groupBy("token", "component", F.col("grp").alias("home")).agg(*whole)
        other = F.col("component") != F.col("there")
    fits = (F.col("grp") != F.col("home")) & (F.col("high") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("low") * percent)
    enough = F.least("rest", "tail") * (100 + percent) >= (F.col("least") + F.col("low")) * percent
    pairs = queries.join(matrix, "token").where(fits & enough & other)
    if hub is None:
        return pairs.select("grp", "node", "component").distinct()
    return pairs.groupBy("grp", "component").agg(F.min("node").alias("node"))


def _open_groups(nodes: DataFrame, labels: DataFrame, percent: int, hub: str | None) -> DataFrame:
    """Links found by opening groups to those who ask; a group with many asks is opened in several tasks."""
    asks = materialise(_qualifying(nodes, labels, percent, hub).select("grp", "node", "component"), "asks")
    tasks = asks.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(OPENED)).alias("tasks"))
    dealt = materialise(asks.join(tasks, "grp").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks"))).drop("tasks"), "dealt")
    tokens = nodes.select("node", "tokens")
    # toDF gives the columns an identity of their own, apart from those of the members
    asked = dealt.join(tokens, "node").select("grp", "task", "component", "tokens").toDF("grp", "task", "component", "tokens")
    members = labels.join(dealt.select("grp", "task").distinct(), "grp").join(tokens, "node").select("grp", "task", "component", "tokens")
    return members.groupBy("grp", "task").cogroup(asked.groupBy("grp", "task")).applyInArrow(_links_to_queries(percent), "a binary, b binary")
