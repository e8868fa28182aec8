"""The queries once more, as plain SQL written independently of the DataFrame operators."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Fixed classes: white space, and letters, digits and the underscore.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
# Fixed class: capitals, including letters used as numbers and in circles or squares.
UPPER = r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"


def _coin(*parts: str) -> str:
    joined = ", ".join(["'42'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _news(ts: str) -> str:
    return f"('n' || strftime({ts}, '%Y%m%d%H'))"


def _hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3.6e9)"


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _literal(text: str, token: str) -> str:
    return f"((length({text}) - length(replace({text}, '{token}', ''))) // {len(token)})"


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
ZERO_LIKES, ZERO_RETWEETS = "coalesce(likes, 0)", "coalesce(retweets, 0)"
STYLE = {
    "exclaims": _literal("body", "!"),
    "questions": _literal("body", "?"),
    "ellipses": _literal("body", "..."),
    "caps": _hits("body", "[A-Z]{2,}"),
    "urls": _hits("body", f"http[^{SPACE}]+"),
    "mentions": _hits("body", f"@[{WORD}]+"),
    "hashtags": _hits("body", f"#[{WORD}]+"),
}
EXCITEMENT = f"({STYLE['exclaims']} + {STYLE['questions']} + {_hits('body', f'[{UPPER}]')} / (length(body) + 1))"
X = [f"x{i}" for i in range(8)]

# name -> (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tweets": ((), f"""
        SELECT {_news('e.ts')} AS news_id, {_news('e.ts')} || '_t' || e.event_id AS tweet_id, 'u' || e.user_id AS user_id,
               CASE WHEN e.event_id % 29 <> 0 THEN
                 (CASE WHEN e.event_id % 4 <> 0 THEN 'RT @u' || (e.user_id + 1) || ': ' ELSE '' END) || e.event_type
                 || repeat('!', CAST(e.event_id % 5 AS INTEGER)) || ' #t' || (e.event_id % 13) END AS text,
               e.ts AS timestamp,
               CASE WHEN e.event_id % 53 <> 0 THEN CAST(floor(e.value) AS BIGINT) END AS likes, {K} AS retweets,
               e.event_type = 'signup' AS is_root, CAST(day(e.ts) % 2 AS INTEGER) AS label,
               CAST(e.user_id AS DOUBLE) AS user_followers, e.user_id % 20 = 0 AS user_verified,
               (e.user_id % 10) / 10.0::DOUBLE AS user_credibility, (e.user_id % 7) / 7.0::DOUBLE AS user_bot_score,
               CASE WHEN e.user_id % 20 = 0 THEN 'verified' WHEN e.user_id % 20 <= 2 THEN 'bot' ELSE 'regular' END AS user_type,
               e.event_id AS event_id, e.user_id AS user_no
        FROM events e"""),
    "edges": ((), f"""
        SELECT {_news('p.ts')} || '_t' || p.event_id AS source, {_news('c.ts')} || '_t' || c.event_id AS target,
               c.ts AS timestamp, c.event_id AS event_id
        FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4
                             WHEN event_id % 16 <> 0 THEN event_id - event_id % 16
                             WHEN event_id % 64 <> 0 THEN event_id - event_id % 64 END AS parent FROM events) c
        JOIN events p ON p.event_id = c.parent"""),
    "noisy": (("edges",), """
        SELECT source, target FROM edges
        UNION ALL SELECT target, source FROM edges WHERE event_id % 97 = 1
        UNION ALL SELECT 'lost_' || event_id, target FROM edges WHERE event_id % 97 = 2
        UNION ALL SELECT source, target FROM edges WHERE event_id % 97 = 3
        UNION ALL SELECT source, 'lost_' || event_id FROM edges WHERE event_id % 97 = 4
        UNION ALL SELECT 'lost_' || event_id, 'lost_' || event_id FROM edges WHERE event_id % 97 = 5"""),
    "ordered": (("tweets",), """
        SELECT *, pos + 1 AS node_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY timestamp, tweet_id) - 1 AS pos,
                 count(*) OVER (PARTITION BY news_id) AS cascade_size FROM tweets) WHERE cascade_size >= 2"""),
    "graphs": (("ordered",), """
        SELECT news_id, label, cascade_size, cascade_size + 1 AS num_nodes, label = 1 AS is_fake
        FROM ordered WHERE pos = 0"""),
    "seen": (("tweets",), """
        SELECT news_id, user_id, row_number() OVER (PARTITION BY news_id ORDER BY ts, id, user_id) AS user_idx,
               count(*) OVER (PARTITION BY news_id) AS n_users
        FROM (SELECT news_id, user_id, min(timestamp) AS ts, arg_min(tweet_id, timestamp) AS id
              FROM tweets GROUP BY news_id, user_id)"""),
    "user_idx": (("seen",), "SELECT news_id, user_id, user_idx FROM seen WHERE n_users >= 3"),
    "links": (("tweets", "edges"), """
        SELECT s.news_id, e.source, e.target FROM edges e JOIN tweets s ON s.tweet_id = e.source
        JOIN tweets t ON t.tweet_id = e.target AND t.news_id = s.news_id"""),
    "noisy_links": (("tweets", "noisy"), """
        SELECT s.news_id, e.source, e.target FROM noisy e JOIN tweets s ON s.tweet_id = e.source
        JOIN tweets t ON t.tweet_id = e.target AND t.news_id = s.news_id"""),
    "patterns": ((), f"""
        SELECT {_news('ts')} AS pattern_id, any_value(day(ts) % 2 = 1) AS is_fake, count(*) AS num_nodes,
               nullif(count(*) FILTER (event_id % 64 = 0), 0) AS level_0,
               nullif(count(*) FILTER (event_id % 16 = 0 AND event_id % 64 <> 0), 0) AS level_1,
               nullif(count(*) FILTER (event_id % 4 = 0 AND event_id % 16 <> 0), 0) AS level_2
        FROM events GROUP BY 1"""),
    "offered": (("graphs", "patterns"), """
        SELECT g.news_id, g.is_fake, g.cascade_size, p.pattern_id, p.num_nodes, p.level_0, p.level_1, p.level_2,
               abs(p.num_nodes - g.cascade_size) <= greatest(5, g.cascade_size * 0.3) AS alike
        FROM graphs g JOIN patterns p ON p.is_fake = g.is_fake"""),
    "matched": (("offered",), f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY num_nodes, pattern_id) - 1 AS r,
                 count(*) OVER (PARTITION BY news_id) AS options
          FROM (SELECT *, bool_or(alike) OVER (PARTITION BY news_id) AS any_alike FROM offered)
          WHERE alike OR NOT any_alike)
        WHERE r = floor({_coin('news_id', "'pattern'")} * options)"""),
    "patterned": (("ordered", "matched"), """
        SELECT *, CASE WHEN deep AND level_2 IS NOT NULL AND n > 3 THEN least(level_2, n // 3) ELSE 0 END AS two
        FROM (SELECT o.news_id, o.pos, o.cascade_size AS n, m.level_2, m.is_fake, o.likes, o.retweets,
                     m.level_0 IS NOT NULL AND m.level_1 IS NOT NULL AS deep,
                     CASE WHEN m.level_0 IS NOT NULL AND m.level_1 IS NOT NULL
                          THEN least(m.level_1, o.cascade_size // 2) ELSE 0 END AS one
              FROM ordered o JOIN matched m USING (news_id))"""),
    "news_e": (("ordered",), "SELECT news_id, 0 AS src_idx, node_idx AS dst_idx, 'news' AS kind FROM ordered"),
    "cascade_e": (("ordered", "edges"), """
        SELECT s.news_id, s.node_idx AS src_idx, t.node_idx AS dst_idx, 'cascade' AS kind
        FROM edges e JOIN ordered s ON s.tweet_id = e.source AND starts_with(e.source, s.news_id)
        JOIN ordered t ON t.tweet_id = e.target AND t.news_id = s.news_id"""),
    "lookback": (("ordered",), f"""
        SELECT b.news_id, b.node_idx AS src_idx, a.node_idx AS dst_idx,
               exp(-{_hours('a.timestamp', 'b.timestamp')} / 24.0)
               * CASE WHEN a.user_type = b.user_type THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
               * least(2.0::DOUBLE, pow(b.retweets::DOUBLE + 1, 0.2::DOUBLE)) * 0.3::DOUBLE AS p
        FROM ordered a JOIN ordered b ON b.news_id = a.news_id AND b.pos < a.pos AND b.pos >= a.pos - 5"""),
    "heuristic_e": (("lookback",), f"""
        SELECT news_id, src_idx, dst_idx, 'heuristic' AS kind FROM lookback
        WHERE {_coin('news_id', "'heuristic'", 'src_idx', 'dst_idx')} < p"""),
    "level1_e": (("patterned",), """
        SELECT news_id, pos + 1 AS src_idx, pos + 2 AS dst_idx, 'level1' AS kind
        FROM patterned WHERE pos < one AND pos < n - 1"""),
    "level2_e": (("patterned",), """
        SELECT news_id, least(pos, n // 2) + 1 AS src_idx, least(one + pos, n - 1) + 1 AS dst_idx, 'level2' AS kind
        FROM patterned WHERE pos < two AND least(pos, n // 2) < least(one + pos, n - 1)"""),
    "popular": (("ordered",), """
        SELECT a.news_id, a.tweet_id, a.pos,
               coalesce(first(b.pos ORDER BY b.likes + b.retweets DESC, b.pos) FILTER (b.likes + b.retweets > 0), 0) AS popular_pos
        FROM ordered a LEFT JOIN ordered b ON b.news_id = a.news_id AND b.pos < a.pos GROUP BY 1, 2, 3"""),
    "star_e": (("popular",), f"""
        SELECT news_id, popular_pos + 1 AS src_idx, pos + 1 AS dst_idx, 'star' AS kind
        FROM popular WHERE pos >= 2 AND {_coin('news_id', "'star'", 'popular_pos + 1', 'pos + 1')} < 0.6::DOUBLE"""),
    "chain_e": (("ordered",), f"""
        SELECT news_id, pos AS src_idx, pos + 1 AS dst_idx, 'chain' AS kind
        FROM ordered WHERE pos BETWEEN 1 AND 7 AND {_coin('news_id', "'chain'", 'pos', 'pos + 1')} < 0.4::DOUBLE"""),
    "news_f": (("tweets",), f"""
        SELECT *, n_tweets / (span_hours + 1) AS velocity FROM (
          SELECT news_id, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users,
                 CAST(sum({ZERO_LIKES}) AS DOUBLE) AS sum_likes, CAST(sum({ZERO_RETWEETS}) AS DOUBLE) AS sum_retweets,
                 avg({ZERO_LIKES}) AS mean_likes, avg({ZERO_RETWEETS}) AS mean_retweets,
                 {_hours('max(timestamp)', 'min(timestamp)')} AS span_hours
          FROM tweets GROUP BY news_id) WHERE n_tweets >= 2"""),
    "tweet_f": (("tweets",), """
        SELECT news_id, tweet_id, coalesce(likes, 0)::DOUBLE AS likes, coalesce(retweets, 0)::DOUBLE AS retweets,
               is_root::INTEGER::DOUBLE AS is_root, coalesce(nullif(user_followers, 0), 1000)::DOUBLE AS followers,
               user_verified::INTEGER::DOUBLE AS verified, coalesce(nullif(user_credibility, 0), 0.5)::DOUBLE AS credibility,
               coalesce(nullif(user_bot_score, 0), 0.1)::DOUBLE AS bot_score,
               (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) > 2)::INTEGER::DOUBLE AS emotional
        FROM tweets"""),
    "nodes": (("news_f", "tweet_f", "ordered"), """
        SELECT news_id, 0 AS node_idx, n_tweets::DOUBLE AS x0, n_users::DOUBLE AS x1, sum_likes AS x2, sum_retweets AS x3,
               mean_likes AS x4, mean_retweets AS x5, span_hours AS x6, velocity AS x7 FROM news_f
        UNION ALL
        SELECT o.news_id, o.node_idx, f.likes, f.retweets, f.is_root, f.followers, f.verified, f.credibility, f.bot_score, f.emotional
        FROM ordered o JOIN tweet_f f USING (tweet_id)"""),
    "all_e": (("news_e", "cascade_e", "level1_e", "level2_e", "star_e", "chain_e", "graphs"), """
        SELECT * FROM news_e
        UNION ALL SELECT * FROM cascade_e UNION ALL SELECT * FROM level1_e UNION ALL SELECT * FROM level2_e
        UNION ALL SELECT * FROM star_e WHERE news_id IN (SELECT news_id FROM graphs WHERE is_fake)
        UNION ALL SELECT * FROM chain_e WHERE news_id IN (SELECT news_id FROM graphs WHERE NOT is_fake)"""),
    "graph_e": (("all_e",), "SELECT news_id, src_idx, dst_idx FROM all_e"),
    "looped": (("nodes", "graph_e"), """
        SELECT * FROM graph_e UNION ALL SELECT news_id, node_idx, node_idx FROM nodes"""),
    "degrees": (("looped",), "SELECT news_id, dst_idx AS node_idx, count(*) AS d FROM looped GROUP BY 1, 2"),
    "weights": (("looped", "degrees"), """
        SELECT l.news_id, l.src_idx, l.dst_idx, 1 / sqrt(s.d * t.d) AS weight FROM looped l
        JOIN degrees s ON s.news_id = l.news_id AND s.node_idx = l.src_idx
        JOIN degrees t ON t.news_id = l.news_id AND t.node_idx = l.dst_idx"""),
    "round1": (("nodes", "weights"), f"""
        SELECT w.news_id, w.dst_idx AS node_idx, {', '.join(f'sum(w.weight * n.{x}) AS {x}' for x in X)}
        FROM weights w JOIN nodes n ON n.news_id = w.news_id AND n.node_idx = w.src_idx GROUP BY 1, 2"""),
    "round2": (("round1", "weights"), f"""
        SELECT w.news_id, w.dst_idx AS node_idx, {', '.join(f'sum(w.weight * n.{x}) AS {x}' for x in X)}
        FROM weights w JOIN round1 n ON n.news_id = w.news_id AND n.node_idx = w.src_idx GROUP BY 1, 2"""),
    "walk": (("tweets", "links"), """
        SELECT news_id, tweet_id, 0 AS depth FROM tweets WHERE tweet_id NOT IN (SELECT target FROM links)
        UNION ALL SELECT l.news_id, l.target, w.depth + 1 FROM walk w JOIN links l ON l.source = w.tweet_id"""),
    "depths": (("tweets", "walk"), """
        SELECT t.news_id, t.tweet_id, min(w.depth) AS depth
        FROM tweets t LEFT JOIN walk w USING (tweet_id) GROUP BY 1, 2"""),
    "docs": ((), """
        SELECT d.source AS news_id, 'd' || d.doc_id AS tweet_id, d.lang AS user_id,
               CASE WHEN d.doc_id % 31 <> 0 THEN d.text
                 || CASE WHEN d.doc_id % 5 = 0 THEN ' See http://x.co/a?b @you_1 #wow' ELSE '' END
                 || CASE WHEN d.doc_id % 7 = 0 THEN ' NO WAY!!! Really??...' ELSE '' END ELSE '' END AS body,
               CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id % 100 END AS likes, d.doc_id % 7 AS retweets,
               d.doc_id % 10 = 0 AS is_root, coalesce(l.toxic, 0) AS label, (d.doc_id % 50)::DOUBLE AS followers,
               d.doc_id % 9 = 0 AS verified, (d.doc_id % 10) / 10.0::DOUBLE AS credibility
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "styles": (("docs",), f"""
        SELECT news_id, user_id, {', '.join(f'sum({e})::BIGINT AS {n}' for n, e in STYLE.items())} FROM docs GROUP BY 1, 2"""),
    "words": (("docs",), f"""
        SELECT news_id, unnest(list_filter(string_split_regex(lower(body), '[{SPACE}]+'), lambda w: w <> '')) AS word FROM docs"""),
    "variety": (("docs", "words"), """
        SELECT news_id, count(DISTINCT word) AS unique_words, count(word) AS total_words,
               count(DISTINCT word) / (count(word) + 1) AS diversity
        FROM (SELECT DISTINCT news_id FROM docs) LEFT JOIN words USING (news_id) GROUP BY news_id"""),
    "scored": ((), f"""
        SELECT 'e' || e.event_id AS news_id, m.model, (e.event_type = 'error')::INTEGER AS label,
               CASE WHEN m.model = 'structure' THEN least(e.value / 500, 1.0::DOUBLE) ELSE {K} / 99.0::DOUBLE END AS p_fake,
               floor(e.value)::DOUBLE AS likes, {K}::DOUBLE AS retweets, e.user_id::DOUBLE AS followers,
               (e.user_id % 20 = 0)::INTEGER::DOUBLE AS verified, (e.user_id % 10) / 10.0::DOUBLE AS credibility,
               (e.user_id % 7) / 7.0::DOUBLE AS bot_score, hour(e.ts)::DOUBLE AS hour, 1.0::DOUBLE AS constant, e.event_id
        FROM events e, (VALUES ('structure'), ('text')) m(model)"""),
    "predictions": (("scored",), "SELECT *, 1 - p_fake AS p_real, (p_fake > 0.5::DOUBLE)::INTEGER AS pred FROM scored"),
    "cells": (("predictions",), """
        SELECT m.model, l.c AS label, p.c AS pred,
               (SELECT count(*) FROM predictions x WHERE x.model = m.model AND x.label = l.c AND x.pred = p.c) AS n
        FROM (SELECT DISTINCT model FROM predictions) m, (VALUES (0), (1)) l(c), (VALUES (0), (1)) p(c)"""),
    "per_class": (("cells",), """
        SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
          SELECT model, c AS class, sum(n) FILTER (label = c) AS support,
                 coalesce(sum(n) FILTER (label = c AND pred = c) / nullif(sum(n) FILTER (pred = c), 0), 0) AS precision,
                 coalesce(sum(n) FILTER (label = c AND pred = c) / nullif(sum(n) FILTER (label = c), 0), 0) AS recall
          FROM cells, (VALUES (0), (1)) k(c) GROUP BY 1, 2)"""),
    "report": (("per_class", "cells"), """
        SELECT model, class::VARCHAR AS entry, precision, recall, f1, support FROM per_class
        UNION ALL SELECT model, 'accuracy', a, a, a, s FROM (
          SELECT model, sum(n) FILTER (label = pred) / sum(n) AS a, sum(n) AS s FROM cells GROUP BY 1)
        UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class GROUP BY 1
        UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                         sum(f1 * support) / sum(support), sum(support) FROM per_class GROUP BY 1"""),
    "ranked": (("predictions",), """
        SELECT *, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM predictions"""),
    "aucs": (("ranked",), """
        SELECT run, model, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
               (sum(r) FILTER (label = 1) - positives * (positives + 1) / 2) / nullif(positives * negatives, 0) AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY run, model ORDER BY p_fake)
                        + (count(*) OVER (PARTITION BY run, model, p_fake) - 1) / 2 AS r FROM ranked) GROUP BY 1, 2"""),
    "runs": (("ranked", "aucs"), """
        SELECT *, (SELECT a.auc FROM aucs a WHERE a.run = m.run AND a.model = m.model) AS auc FROM (
          SELECT run, model, avg((label = pred)::INTEGER) AS accuracy,
                 2 * count(*) FILTER (label = 1 AND pred = 1)
                   / (count(*) FILTER (label = 1) + count(*) FILTER (pred = 1)) AS f1,
                 avg(-ln(greatest(CASE WHEN label = 1 THEN p_fake ELSE p_real END, 1e-15::DOUBLE))) AS log_loss
          FROM ranked GROUP BY 1, 2) m"""),
    "pairs": (("predictions",), """
        SELECT a.news_id, a.pred AS pred_a, b.pred AS pred_b, a.label
        FROM predictions a JOIN predictions b USING (news_id) WHERE a.model = 'structure' AND b.model = 'text'"""),
    "candidates": ((), f"""
        SELECT *, coalesce(2 * tp / nullif(said + hit, 0), 0) AS val_f1 FROM (
          SELECT 'run' || day(ts) || '_' || (user_id % 3) AS run, hour(ts) AS step,
                 count(*) FILTER (event_type IN ('error', 'view', 'click') AND {K} > 49) AS tp,
                 count(*) FILTER ({K} > 49) AS said, count(*) FILTER (event_type IN ('error', 'view', 'click')) AS hit
          FROM events GROUP BY 1, 2)"""),
}
FEATURES = ["likes", "retweets", "followers", "verified", "credibility", "bot_score", "hour", "constant"]
VIEWS["ratios"] = (("predictions",), " UNION ALL ".join(
    f"""SELECT model, '{f}' AS feature, fake, "real", fake / nullif("real" + 0.001::DOUBLE, 0) AS ratio FROM (
        SELECT model, avg({f}) FILTER (p_fake > 0.9::DOUBLE) AS fake, avg({f}) FILTER (p_real > 0.9::DOUBLE) AS "real"
        FROM predictions GROUP BY model)""" for f in FEATURES))
VIEWS["importance"] = (("predictions",), " UNION ALL ".join(
    f"""SELECT model, '{f}' AS feature, {i} AS no, coalesce(abs(
        CASE WHEN stddev_pop({f}) * stddev_pop(pred) = 0 THEN 0 ELSE corr({f}, pred) END), 0) AS importance
        FROM predictions GROUP BY model""" for i, f in enumerate(FEATURES)))


def _needed(views: tuple[str, ...]) -> list[str]:
    found: list[str] = []
    for view in views:
        for name in (*_needed(tuple(v for v in VIEWS[view][0])), view):
            if name not in found:
                found.append(name)
    return found


def oracle(name: str, views: str, select: str) -> None:
    needed = _needed(tuple(views.split()))
    recursive = "RECURSIVE " if "walk" in needed else ""
    # A view read several times is computed once.
    with_ = ",\n".join(f"{v} AS {'' if v == 'walk' else 'MATERIALIZED '}({VIEWS[v][1]})" for v in needed)
    ORACLE[name] = (f"WITH {recursive}{with_}\n" if needed else "") + select


def r(value: str, name: str | None = None) -> str:
    return f"round(CAST({value} AS DOUBLE), 6) + 0.0 AS {name or value.split('.')[-1]}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


# --- sources, sinks, schema -------------------------------------------------------------------

oracle("read_tweets", "tweets", f"""SELECT tweet_id, user_id, text, epoch_us(timestamp) AS ts_us, likes, retweets, is_root,
    label, news_id, {rs('user_followers')}, user_verified, {rs('user_credibility', 'user_bot_score')}, user_type FROM tweets"""
    .replace(", round(CAST(user_bot_score AS DOUBLE), 6) + 0.0 AS user_bot_score", ""))
oracle("read_edges", "edges", "SELECT source, target, epoch_us(timestamp) AS ts_us FROM edges")
oracle("read_patterns", "patterns", "SELECT is_fake, num_nodes, level_0, level_1, level_2 FROM patterns")
oracle("align_schema", "tweets", f"""SELECT tweet_id, {rs('user_followers')}, false AS user_verified,
    {rs('user_credibility')}, {r("CASE WHEN retweets % 2 = 0 THEN user_bot_score ELSE 0.1 END", 'user_bot_score')}, user_type FROM tweets""")
oracle("align_schema_user", "tweets", f"""SELECT tweet_id, {r('user_followers', 'followers')}, 0.0::DOUBLE AS "following",
    user_verified AS verified, {r("CASE WHEN user_no % 3 <> 0 THEN user_credibility ELSE 0.5 END", 'credibility')},
    {r('user_followers * 0.1', 'user_following')} FROM tweets""")
oracle("write_graphs", "graphs graph_e", """SELECT g.*, g.num_nodes AS nodes, e.edges FROM graphs g
    JOIN (SELECT news_id, count(*) AS edges FROM graph_e GROUP BY 1) e USING (news_id)""")
oracle("write_user_graphs", "links user_idx", """SELECT u.news_id, g.label, g.label = 1 AS is_fake, u.n + 1 AS num_nodes, u.n + 1 AS nodes,
    2 * u.n + 2 * coalesce(e.n, 0) AS edges
    FROM (SELECT news_id, count(*) AS n FROM user_idx GROUP BY 1) u
    JOIN (SELECT news_id, arg_min(label, timestamp) AS label FROM tweets GROUP BY 1) g USING (news_id)
    LEFT JOIN (SELECT l.news_id, count(*) AS n FROM links l JOIN tweets s ON s.tweet_id = l.source
      JOIN tweets t ON t.tweet_id = l.target WHERE s.user_id <> t.user_id GROUP BY 1) e USING (news_id)""")
oracle("write_edges_tweets", "tweets edges", """SELECT t.news_id, t.tweets, t.likes, coalesce(e.edges, 0) AS edges FROM
    (SELECT news_id, count(*) AS tweets, sum(likes)::BIGINT AS likes FROM tweets GROUP BY 1) t LEFT JOIN
    (SELECT split_part(source, '_t', 1) AS news_id, count(*) AS edges FROM edges GROUP BY 1) e USING (news_id)""")
oracle("results_table", "runs", f"SELECT run, model, {rs('accuracy', 'f1', 'auc', 'log_loss')} FROM runs")

# --- cascades ---------------------------------------------------------------------------------

oracle("cascade_group", "tweets", "SELECT news_id, count(*) AS cascade_size FROM tweets GROUP BY 1")
oracle("min_size_filter", "tweets", "SELECT news_id, count(*) AS cascade_size FROM tweets GROUP BY 1 HAVING count(*) >= 2")
oracle("min_users_filter", "", """SELECT 'c' || conv_id AS news_id, count(DISTINCT role) AS n_users FROM conversations
    GROUP BY 1 HAVING count(DISTINCT role) >= 3""")
oracle("propagation_order", "ordered", "SELECT news_id, tweet_id, node_idx, cascade_size FROM ordered")
oracle("propagation_order_ties", "", """SELECT * FROM (SELECT 'p' || l_partkey AS news_id, tweet_id,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, tweet_id) AS node_idx,
      count(*) OVER (PARTITION BY l_partkey) AS cascade_size
    FROM (SELECT *, concat_ws('_', 'p', l_partkey, l_orderkey, l_linenumber, l_suppkey) AS tweet_id FROM lineitem))
    WHERE cascade_size >= 2""")
oracle("user_index", "user_idx", "SELECT news_id, user_id, user_idx FROM user_idx")
oracle("cascade_label", "tweets", """SELECT news_id, label, label = 1 AS is_fake FROM (
    SELECT news_id, arg_min(label, timestamp) AS label FROM tweets GROUP BY 1)""")
oracle("node_table", "ordered graphs", """SELECT news_id, 0 AS node_idx, 0 AS node_type, NULL::VARCHAR AS tweet_id FROM graphs
    UNION ALL SELECT news_id, node_idx, 1, tweet_id FROM ordered""")
oracle("user_node_table", "user_idx", """SELECT DISTINCT news_id, 0 AS node_idx, 0 AS node_type, NULL::VARCHAR AS user_id FROM user_idx
    UNION ALL SELECT news_id, user_idx, 1, user_id FROM user_idx""")
oracle("graph_table", "graphs", "SELECT * FROM graphs")
oracle("credibility_sample", "", f"""SELECT team, user_id, {rs('credibility')}, pick FROM (
    SELECT *, row_number() OVER (PARTITION BY team ORDER BY {_coin('team', 'user_id')}, user_id) AS pick FROM (
      SELECT DISTINCT event_type AS team, 'u' || e.user_id AS user_id, (e.user_id % 10) / 10.0::DOUBLE AS credibility FROM events e)
    WHERE credibility < 0.4::DOUBLE) WHERE pick <= 5""")
oracle("user_tier", "", """SELECT user_id, user_type, place, row_number() OVER (PARTITION BY user_type ORDER BY place) - 1 AS tier_no FROM (
    SELECT 'u' || user_no AS user_id, place, CASE WHEN place < total * 0.05::DOUBLE THEN 'verified'
      WHEN place < total * 0.15::DOUBLE THEN 'bot' ELSE 'regular' END AS user_type FROM (
      SELECT user_no, row_number() OVER (ORDER BY user_no) - 1 AS place, count(*) OVER () AS total
      FROM (SELECT DISTINCT user_id AS user_no FROM events)))""")
oracle("head_examples", "graphs", "SELECT * FROM graphs ORDER BY news_id LIMIT 50")

# --- edges ------------------------------------------------------------------------------------

oracle("news_edges", "news_e", "SELECT * FROM news_e")
oracle("cascade_edges", "ordered noisy", """SELECT s.news_id, s.node_idx AS src_idx, t.node_idx AS dst_idx, 'cascade' AS kind
    FROM noisy e JOIN ordered s ON s.tweet_id = e.source JOIN ordered t ON t.tweet_id = e.target AND t.news_id = s.news_id
    WHERE starts_with(e.source, s.news_id)""")
oracle("heuristic_edges", "heuristic_e", "SELECT * FROM heuristic_e")
oracle("heuristic_edge_prob", "lookback", f"SELECT news_id, src_idx, dst_idx, {rs('p')} FROM lookback")
oracle("pattern_match", "matched", """SELECT news_id, is_fake, cascade_size, pattern_id, num_nodes, level_0, level_1, level_2
    FROM matched""")
oracle("pattern_level1", "level1_e", "SELECT * FROM level1_e")
oracle("pattern_level2", "level2_e", "SELECT * FROM level2_e")
oracle("popular_star", "star_e", "SELECT * FROM star_e")
oracle("sequential_chain", "chain_e", "SELECT * FROM chain_e")
oracle("all_edges", "all_e", "SELECT * FROM all_e")
oracle("all_edges_lookback", "news_e cascade_e heuristic_e", """SELECT * FROM news_e
    UNION ALL SELECT * FROM cascade_e UNION ALL SELECT * FROM heuristic_e""")
oracle("user_star", "user_idx", """SELECT news_id, 0 AS src_idx, user_idx AS dst_idx, 'news' AS kind FROM user_idx
    UNION ALL SELECT news_id, user_idx, 0, 'news' FROM user_idx""")
_LIFTED = """FROM links l JOIN tweets s ON s.tweet_id = l.source JOIN tweets t ON t.tweet_id = l.target
    JOIN user_idx a ON a.news_id = l.news_id AND a.user_id = s.user_id
    JOIN user_idx b ON b.news_id = l.news_id AND b.user_id = t.user_id WHERE a.user_idx <> b.user_idx"""
oracle("user_interaction", "links user_idx", f"""SELECT l.news_id, a.user_idx AS src_idx, b.user_idx AS dst_idx, 'interaction' AS kind {_LIFTED}
    UNION ALL SELECT l.news_id, b.user_idx, a.user_idx, 'interaction' {_LIFTED}""")
oracle("text_lookup", "ordered graphs", """SELECT news_id, 0 AS node_idx, NULL::VARCHAR AS tweet_id,
      'News article ' || (row_number() OVER (ORDER BY news_id) - 1) AS text FROM graphs
    UNION ALL SELECT news_id, node_idx, tweet_id,
      CASE WHEN event_id % 17 = 0 THEN 'Tweet ' || tweet_id ELSE coalesce(text, '') END FROM ordered""")
_TWEET_F = ["likes", "retweets", "is_root", "followers", "verified", "credibility", "bot_score", "emotional"]
oracle("feature_concat", "tweet_f tweets", "SELECT f.tweet_id, "
    + ", ".join([r(f"f.{n}", f"x{i}") for i, n in enumerate(_TWEET_F)] + [r(f"v.embedding[{i + 1}]", f"x{8 + i}") for i in range(64)])
    + " FROM tweet_f f JOIN tweets t USING (tweet_id) JOIN embeddings v ON v.vec_id = t.event_id % (SELECT count(*) FROM embeddings)")

# --- features ---------------------------------------------------------------------------------

oracle("news_features", "news_f", f"""SELECT news_id, n_tweets, n_users,
    {rs('sum_likes', 'sum_retweets', 'mean_likes', 'mean_retweets', 'span_hours', 'velocity')} FROM news_f""")
oracle("tweet_features", "tweet_f", f"SELECT news_id, tweet_id, {rs(*_TWEET_F)} FROM tweet_f")
oracle("user_features", "tweets", f"""SELECT news_id, user_id, count(*) AS n_tweets, {r(f'avg({ZERO_LIKES})', 'mean_likes')},
    {r(f'avg({ZERO_RETWEETS})', 'mean_retweets')}, bool_or(is_root)::INTEGER::DOUBLE AS any_root,
    {r('avg(user_followers)', 'followers')}, {r('avg(user_followers * 2)', '"following"')},
    bool_or(user_verified)::INTEGER::DOUBLE AS verified,
    {r('avg(CASE WHEN user_no % 3 <> 0 THEN user_credibility ELSE 0.5 END)', 'credibility')} FROM tweets GROUP BY 1, 2""")
oracle("user_features_text", "docs styles", f"""SELECT d.*, {r('(' + ' + '.join(f's.{n}' for n in STYLE) + ') / 7', 'style')} FROM (
    SELECT news_id, user_id, count(*) AS n_tweets, {r('avg(likes)', 'mean_likes')}, {r('avg(retweets)', 'mean_retweets')},
      bool_or(is_root)::INTEGER::DOUBLE AS any_root, {r('avg(followers)', 'followers')},
      {r('avg(followers * 0.1::DOUBLE)', '"following"')}, bool_or(verified)::INTEGER::DOUBLE AS verified,
      {r('avg(credibility)', 'credibility')} FROM docs GROUP BY 1, 2) d JOIN styles s USING (news_id, user_id)""")
_USER_ROW = ["count(*)", f"avg({ZERO_LIKES})", f"avg({ZERO_RETWEETS})", "bool_or(is_root)::INTEGER", "avg(user_followers)",
    "avg(user_followers * 2)", "bool_or(user_verified)::INTEGER",
    "avg(CASE WHEN user_no % 3 <> 0 THEN user_credibility ELSE 0.5 END)"]
_NEWS_ROW = ["n_tweets", "n_users", "sum_likes", "sum_retweets", "mean_likes", "mean_retweets", "span_hours", "velocity"]
oracle("user_matrix", "news_f user_idx tweets", f"""
    SELECT news_id, 0 AS node_idx, 0 AS node_type, {', '.join(r(c, f'x{i}') for i, c in enumerate(_NEWS_ROW))}
    FROM news_f WHERE news_id IN (SELECT news_id FROM user_idx)
    UNION ALL SELECT t.news_id, any_value(u.user_idx), 1, {', '.join(r(c, f'x{i}') for i, c in enumerate(_USER_ROW))}
    FROM tweets t JOIN user_idx u ON u.news_id = t.news_id AND u.user_id = t.user_id GROUP BY t.news_id, t.user_id""")
_DOC_ROW = ["count(*)", "avg(likes)", "avg(retweets)", "bool_or(is_root)::INTEGER", "avg(followers)", "avg(followers * 0.1::DOUBLE)",
    "bool_or(verified)::INTEGER", "avg(credibility)", "(" + " + ".join(f"sum({e})" for e in STYLE.values()) + ") / 7"]
_DOC_NEWS = ["count(*)", "count(DISTINCT user_id)", "sum(likes)", "sum(retweets)", "avg(likes)", "avg(retweets)",
    "any_value(diversity)", f"var_pop({EXCITEMENT})", "0"]
oracle("user_matrix_text", "docs variety", f"""
    SELECT news_id, 0 AS node_idx, 0 AS node_type, {', '.join(r(c, f'x{i}') for i, c in enumerate(_DOC_NEWS))}
    FROM docs JOIN variety USING (news_id) GROUP BY 1 HAVING count(DISTINCT user_id) >= 3
    UNION ALL SELECT news_id, row_number() OVER (PARTITION BY news_id ORDER BY first_doc), 1, {', '.join(f'x{i}' for i in range(9))} FROM (
      SELECT news_id, min(substr(tweet_id, 2)::BIGINT) AS first_doc, count(*) OVER (PARTITION BY news_id) AS n,
             {', '.join(r(c, f'x{i}') for i, c in enumerate(_DOC_ROW))} FROM docs GROUP BY news_id, user_id) WHERE n >= 3""")
oracle("news_text_stats", "docs variety", f"""SELECT a.*, {r('v.diversity')} FROM (
    SELECT news_id, count(*) AS n_tweets, count(DISTINCT user_id) AS n_users, {r('sum(likes)', 'sum_likes')},
      {r('sum(retweets)', 'sum_retweets')}, {r('avg(likes)', 'mean_likes')}, {r('avg(retweets)', 'mean_retweets')},
      {r(f'var_pop({EXCITEMENT})', 'variance')} FROM docs GROUP BY 1) a JOIN variety v USING (news_id)""")
oracle("text_diversity", "variety", f"SELECT news_id, unique_words, total_words, {rs('diversity')} FROM variety")
oracle("sentiment_variance", "docs", f"SELECT news_id, {r(f'var_pop({EXCITEMENT})', 'variance')} FROM docs GROUP BY 1")
oracle("writing_style", "styles", f"SELECT *, {r('(' + ' + '.join(STYLE) + ') / 7', 'style')} FROM styles")
oracle("time_since_news", "tweets", f"""SELECT news_id, tweet_id,
    {r(_hours('timestamp', 'min(timestamp) OVER (PARTITION BY news_id)'), 'time_since_news')} FROM tweets""")
_DEGREE = """SELECT t.news_id, t.tweet_id, (SELECT count(*) FROM links l WHERE l.target = t.tweet_id) AS in_degree,
    (SELECT count(*) FROM links l WHERE l.source = t.tweet_id) AS out_degree FROM tweets t"""
oracle("node_degree", "tweets links", f"SELECT *, in_degree + out_degree AS degree FROM ({_DEGREE})")
oracle("cascade_depth", "depths", "SELECT *, max(depth) OVER (PARTITION BY news_id) AS max_depth FROM depths")
_CHILDREN = """SELECT t.news_id, t.tweet_id, count(c.tweet_id) AS children,
    count(*) FILTER (starts_with(c.text, 'RT @')) AS retweet_count
    FROM tweets t LEFT JOIN links l ON l.source = t.tweet_id LEFT JOIN tweets c ON c.tweet_id = l.target GROUP BY 1, 2"""
oracle("reply_retweet_count", "tweets links", f"SELECT *, children - retweet_count AS reply_count FROM ({_CHILDREN})")
# Descendants within two hops, listed one by one.
_REACH = """SELECT t.news_id, t.tweet_id, count(DISTINCT d.target) AS local_influence FROM tweets t LEFT JOIN (
      SELECT source, target FROM links
      UNION ALL SELECT a.source, b.target FROM links a JOIN links b ON b.source = a.target) d ON d.source = t.tweet_id GROUP BY 1, 2"""
oracle("local_influence", "tweets links", _REACH)
oracle("local_influence_noisy", "tweets noisy_links", """SELECT t.news_id, t.tweet_id, count(DISTINCT d.target) AS local_influence FROM tweets t LEFT JOIN (
      SELECT source, target FROM noisy_links
      UNION ALL SELECT a.source, b.target FROM noisy_links a JOIN noisy_links b ON b.source = a.target) d
    ON d.source = t.tweet_id AND d.target <> t.tweet_id GROUP BY 1, 2""")
oracle("branching_by_level", "depths", "SELECT news_id, depth, count(*) AS nodes FROM depths WHERE depth IS NOT NULL GROUP BY 1, 2")
oracle("patterns_from_cascades", "depths graphs", """SELECT d.news_id AS pattern_id, any_value(g.is_fake) AS is_fake, count(*) AS num_nodes,
    nullif(count(*) FILTER (depth = 0), 0) AS level_0, nullif(count(*) FILTER (depth = 1), 0) AS level_1,
    nullif(count(*) FILTER (depth = 2), 0) AS level_2 FROM depths d JOIN graphs g USING (news_id) WHERE depth IS NOT NULL GROUP BY 1""")
oracle("declared_features", "tweets depths links", f"""SELECT t.news_id, t.tweet_id, {r('t.user_followers', 'followers')},
    t.user_verified::INTEGER::DOUBLE AS verified,
    {r(_hours('t.timestamp', 'min(t.timestamp) OVER (PARTITION BY t.news_id)'), 'time_since_news')},
    g.in_degree + g.out_degree AS degree, d.depth, c.retweet_count, c.children - c.retweet_count AS reply_count, i.local_influence
    FROM tweets t JOIN ({_DEGREE}) g USING (tweet_id) JOIN depths d USING (tweet_id) JOIN ({_CHILDREN}) c USING (tweet_id)
    JOIN ({_REACH}) i USING (tweet_id)""")
oracle("cascade_size", "ordered", "SELECT tweet_id, cascade_size FROM ordered")
oracle("dataset_profile", "graphs edges", f"""SELECT label, count(*) AS articles, sum(cascade_size)::BIGINT AS tweets,
    {r('avg(cascade_size)', 'mean_size')}, {r('count(*) / (SELECT count(*) FROM graphs)', 'share')},
    CASE WHEN label IS NULL THEN (SELECT count(*) FROM edges) END AS edges FROM graphs GROUP BY ROLLUP (label)""")
_ENDS = f"^[{SPACE}]+|[{SPACE}]+$"
oracle("tweet_text_clean", "", f"""SELECT doc_id, substr(CASE WHEN contains(substr(flat, 1, 50), ':')
      THEN regexp_replace(substr(flat, instr(flat, ':') + 1), '{_ENDS}', '', 'g') ELSE flat END, 1, 280) AS clean_text FROM (
    SELECT doc_id, replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN ' \t' || 'Sure, here it is: ' ELSE '' END || text || ' ' || chr(10),
      '{_ENDS}', '', 'g'), chr(10), ' ') AS flat FROM documents)""")
oracle("retweet_text", "tweets edges", """SELECT e.source, e.target,
    'RT @' || t.user_id || ': ' || substr(coalesce(t.text, ''), 1, 200) || '...' AS text
    FROM edges e JOIN tweets t ON t.tweet_id = e.source""")

# --- windows ----------------------------------------------------------------------------------

oracle("lookback_window", "ordered", """SELECT news_id, node_idx, least(pos, 5) AS seen, greatest(node_idx - 5, 1) AS first_seen,
    node_idx - 1 AS last_seen FROM ordered WHERE pos > 0""")
oracle("running_popular", "popular", "SELECT news_id, tweet_id, pos, popular_pos FROM popular")
oracle("interarrival", "ordered", f"""SELECT news_id, tweet_id, node_idx, {r('gap', 'gap_hours')}, {r('exp(-gap / 24)', 'decay')} FROM (
    SELECT *, {_hours('timestamp', 'lag(timestamp) OVER (PARTITION BY news_id ORDER BY timestamp, tweet_id)')} AS gap FROM ordered)""")
_RANK = "row_number() OVER (PARTITION BY model ORDER BY round(importance, 12) DESC, no DESC) AS rank"
oracle("rank_features", "importance", f"SELECT model, {_RANK}, feature FROM importance")

# --- graph compute ----------------------------------------------------------------------------

oracle("gcn_norm", "weights", f"SELECT news_id, src_idx, dst_idx, {rs('weight')} FROM weights")
oracle("gcn_propagate", "round2", f"SELECT news_id, node_idx, {rs(*X)} FROM round2")
oracle("gcn_propagate_arrays", "round2", f"SELECT news_id, node_idx, {', '.join(r(f'round({x}, 12)', x) for x in X)} FROM round2")
oracle("gcn_propagate_bucketed", "round2", f"SELECT news_id, node_idx, {', '.join(r(f'round({x}, 12)', x) for x in X)} FROM round2")
_SAGE = f"""SELECT n.news_id, n.node_idx, {', '.join(r(f'any_value(n.{x})', x) for x in X)},
    {', '.join(r(f'coalesce(avg(s.{x}), 0)', f'mean_{x}') for x in X)} FROM nodes n
    LEFT JOIN graph_e e ON e.news_id = n.news_id AND e.dst_idx = n.node_idx
    LEFT JOIN nodes s ON s.news_id = e.news_id AND s.node_idx = e.src_idx GROUP BY 1, 2"""
oracle("sage_mean", "nodes graph_e", _SAGE)
oracle("sage_mean_bucketed", "nodes graph_e", _SAGE)
_AS = " + ".join(f"{0.01 * (i + 1)!r}::DOUBLE * x{i}" for i in range(8))
_AD = " + ".join(f"{0.02 * (4 - i)!r}::DOUBLE * x{i}" for i in range(8))
oracle("gat_attention", "nodes looped", f"""SELECT news_id, dst_idx AS node_idx,
    {', '.join(r(f'sum(w * {x}) / sum(w)', x) for x in X)} FROM (
      SELECT *, exp(e - max(e) OVER (PARTITION BY news_id, dst_idx)) AS w FROM (
        SELECT l.news_id, l.dst_idx, {', '.join(f's.{x}' for x in X)},
               CASE WHEN s.a + t.b > 0 THEN s.a + t.b ELSE 0.2::DOUBLE * (s.a + t.b) END AS e
        FROM looped l JOIN (SELECT *, {_AS} AS a FROM nodes) s ON s.news_id = l.news_id AND s.node_idx = l.src_idx
        JOIN (SELECT news_id, node_idx, {_AD} AS b FROM nodes) t ON t.news_id = l.news_id AND t.node_idx = l.dst_idx))
    GROUP BY 1, 2""")
_MEANS = ", ".join(r(f"avg({x})", f"mean_{x}") for x in X)
_MAXES = ", ".join(r(f"max({x})", f"max_{x}") for x in X)
oracle("mean_max_pool", "nodes", f"SELECT news_id, {_MEANS}, {_MAXES} FROM nodes GROUP BY 1")
oracle("max_pool", "nodes", f"SELECT news_id, {_MAXES} FROM nodes GROUP BY 1")
oracle("news_concat", "nodes", f"""SELECT news_id, {_MAXES}, {', '.join(r(f'max({x}) FILTER (node_idx = 0)', f'news_{x}') for x in X)}
    FROM nodes GROUP BY 1""")
oracle("graph_mean_features", "nodes", f"""SELECT news_id, {', '.join(r(f'avg({x})', x) for x in X)},
    {', '.join(r(f'avg({x}) FILTER (node_idx > 0)', f'tweets_{x}') for x in X)} FROM nodes GROUP BY 1""")
_LAYER = [
    " + ".join([f"({(3 * j + 5 * i) % 11 - 5} * 0.1::DOUBLE) * x{i}" for i in range(8)] + [f"({j % 3 - 1} * 0.1::DOUBLE)"])
    for j in range(4)
]
oracle("linear_layer", "nodes", "SELECT news_id, node_idx, "
    + ", ".join(r(f"greatest({e}, 0)", f"h{j}") for j, e in enumerate(_LAYER)) + " FROM nodes")



def _dense(inputs: list[str], outputs: int, scale: float, relu: bool = False) -> list[str]:
    """The layers of the registered queries, written out."""
    found = []
    for j in range(outputs):
        terms = [f"({((3 * j + 5 * i) % 11 - 5) * scale!r}::DOUBLE) * {x}" for i, x in enumerate(inputs)]
        value = " + ".join([*terms, f"({(j % 3 - 1) * scale!r}::DOUBLE)"])
        found.append(f"greatest({value}, 0)" if relu else value)
    return found


def _columns(expressions: list[str], prefix: str) -> str:
    return ", ".join(f"{e} AS {prefix}{j}" for j, e in enumerate(expressions))


def _spread(source: str, names: list[str]) -> str:
    sums = ", ".join(f"sum(w.weight * n.{x}) AS {x}" for x in names)
    return f"""(SELECT w.news_id, w.dst_idx AS node_idx, {sums} FROM weights w
        JOIN {source} n ON n.news_id = w.news_id AND n.node_idx = w.src_idx GROUP BY 1, 2)"""


H, G = [f"h{j}" for j in range(4)], [f"g{j}" for j in range(4)]
VIEWS["embedded"] = (("nodes",), f"SELECT news_id, node_idx, {_columns(_dense(X, 4, 0.001, True), 'h')} FROM nodes")
VIEWS["conv1"] = (("embedded", "weights"), f"SELECT news_id, node_idx, {_columns(_dense(H, 4, 0.1, True), 'h')} FROM {_spread('embedded', H)}")
VIEWS["conv2"] = (("conv1", "weights"), f"SELECT news_id, node_idx, {_columns(_dense(H, 4, 0.1), 'h')} FROM {_spread('conv1', H)}")
_POOLED = [f"avg(greatest({h}, 0))" for h in H] + [f"max(greatest({h}, 0))" for h in H]
VIEWS["scores"] = (("conv2",), f"""SELECT news_id, {_columns(_dense(G, 2, 0.1), 'z')} FROM (
    SELECT news_id, {_columns(_dense([f'p{j}' for j in range(8)], 4, 0.1), 'g')} FROM (
      SELECT news_id, {_columns(_POOLED, 'p')} FROM conv2 GROUP BY 1))""")
H3 = H[:3]
VIEWS["simple1"] = (("nodes", "weights"), f"SELECT news_id, node_idx, {_columns(_dense(X, 3, 0.001, True), 'h')} FROM {_spread('nodes', X)}")
VIEWS["simple2"] = (("simple1", "weights"), f"SELECT news_id, node_idx, {_columns(_dense(H3, 3, 0.1), 'h')} FROM {_spread('simple1', H3)}")
VIEWS["simple_scores"] = (("simple2",), f"""SELECT news_id, {_columns(_dense(H3, 2, 0.1), 'z')} FROM (
    SELECT news_id, {', '.join(f'max({h}) AS {h}' for h in H3)} FROM simple2 GROUP BY 1)""")


def _classes(scores: str) -> str:
    norm = "greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))"
    return f"""SELECT news_id, {r(f'z0 - ({norm})', 'log_p_real')}, {r(f'z1 - ({norm})', 'log_p_fake')},
        {r(f'exp(z0 - ({norm}))', 'p_real')}, {r(f'exp(z1 - ({norm}))', 'p_fake')}, (z1 > z0)::INTEGER AS pred FROM {scores}"""


oracle("gnn_infer_small", "scores", _classes("scores"))
oracle("gnn_infer_arrays", "scores", _classes("scores"))
oracle("gnn_infer_simple", "simple_scores", _classes("simple_scores"))
oracle("graph_embeddings_small", "conv2 graphs", f"""SELECT c.news_id, any_value(g.label) AS label, {', '.join(r(f'avg(c.{h})', h) for h in H)}
    FROM conv2 c JOIN graphs g USING (news_id) GROUP BY 1""")

# --- learning ---------------------------------------------------------------------------------

_PART = """CASE WHEN place < total * 0.8::DOUBLE THEN 'train' WHEN place < total * 0.9::DOUBLE THEN 'val' ELSE 'test' END"""


def _split(source: str) -> str:
    draw = _coin("news_id", "'split'")
    return f"""SELECT news_id, label, {_PART} AS split FROM (
        SELECT news_id, label, row_number() OVER (PARTITION BY label ORDER BY {draw}, news_id) - 1 AS place,
               count(*) OVER (PARTITION BY label) AS total FROM {source})"""


oracle("stratified_split", "graphs", _split("graphs"))
oracle("stratified_split_items", "docs", f"""SELECT label, split, count(*) AS graphs FROM (
    {_split('(SELECT tweet_id AS news_id, label FROM docs)')}) GROUP BY 1, 2""")
oracle("select_by_val_f1", "candidates", f"""
    SELECT run, max(step) FILTER (better) AS best_step, {r('max(val_f1) FILTER (better)', 'best_f1')}, count(*) AS checks,
           max(step) FILTER (no = stop) AS stopped_at FROM (
      SELECT *, min(no) FILTER (no - last >= 5) OVER (PARTITION BY run) AS stop FROM (
        SELECT *, coalesce(max(no) FILTER (better) OVER (PARTITION BY run ORDER BY step), 0) AS last FROM (
          SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS no, val_f1 > coalesce(max(val_f1) OVER (
            PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS better
          FROM candidates WHERE step % 2 = 0))) WHERE stop IS NULL OR no <= stop GROUP BY run""")

# --- metrics and analysis ---------------------------------------------------------------------

oracle("accuracy", "predictions", f"SELECT model, {r('avg((label = pred)::INTEGER)', 'accuracy')} FROM predictions GROUP BY 1")
oracle("f1_binary", "per_class", f"SELECT model, {rs('precision', 'recall', 'f1')} FROM per_class WHERE class = 1")
oracle("auc", "predictions", f"""SELECT model, positives, negatives, {r('(s - positives * (positives + 1) / 2) / nullif(positives * negatives, 0)', 'auc')} FROM (
    SELECT model, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, sum(r) FILTER (label = 1) AS s
    FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY p_fake) + (count(*) OVER (PARTITION BY model, p_fake) - 1) / 2 AS r
          FROM predictions) GROUP BY 1)""")
oracle("confusion_matrix", "cells", "SELECT model, label, pred, n FROM cells")
oracle("classification_report", "report", f"SELECT model, entry, {rs('precision', 'recall', 'f1')}, support::BIGINT AS support FROM report")
oracle("log_loss", "predictions", f"""SELECT model,
    {r('avg(-ln(greatest(CASE WHEN label = 1 THEN p_fake ELSE p_real END, 1e-15::DOUBLE)))', 'log_loss')} FROM predictions GROUP BY 1""")
oracle("model_agreement", "pairs", f"""SELECT cases, agree, cases - agree AS disagree, {r('100 * agree / cases', 'agree_pct')},
    {r('100 * (cases - agree) / cases', 'disagree_pct')} FROM (
    SELECT count(*) AS cases, count(*) FILTER (pred_a = pred_b) AS agree FROM pairs)""")
oracle("disagreement_cases", "pairs", """SELECT news_id, pred_a, pred_b, label FROM pairs WHERE pred_a <> pred_b
    ORDER BY news_id LIMIT 5""")
oracle("disagreement_direction", "pairs", """SELECT pred_a, pred_b, count(*) AS cases, count(*) FILTER (pred_a = label) AS a_right
    FROM pairs WHERE pred_a <> pred_b GROUP BY 1, 2""")
oracle("high_confidence", "predictions", """SELECT model, count(*) FILTER (p_fake > 0.9::DOUBLE) AS sure_fake,
    count(*) FILTER (p_real > 0.9::DOUBLE) AS sure_real FROM predictions GROUP BY 1""")
oracle("confidence_bands", "predictions", """SELECT m.model, b.band,
    count(*) FILTER (p.pred = 1 AND p.p_fake > b.low AND p.p_fake <= b.high) AS fake_predictions,
    count(*) FILTER (p.pred = 0 AND p.p_real > b.low AND p.p_real <= b.high) AS real_predictions
    FROM (SELECT DISTINCT model FROM predictions) m JOIN predictions p USING (model),
    (VALUES ('>90', 0.9::DOUBLE, 2::DOUBLE), ('70-90', 0.7::DOUBLE, 0.9::DOUBLE), ('50-70', 0.5::DOUBLE, 0.7::DOUBLE)) b(band, low, high)
    GROUP BY 1, 2""")
oracle("confidence_histogram", "predictions", f"""SELECT g.model, g.label, g.bin, {r('g.low + g.bin * g.step', 'left_edge')}, count(p) AS n FROM (
      SELECT model, label, unnest(range(20)) AS bin, low, (high - low) / 20 AS step FROM (
        SELECT model, label, min(p) AS low, max(p) AS high FROM (
          SELECT model, label, CASE WHEN label = 1 THEN p_fake ELSE p_real END AS p FROM predictions) GROUP BY 1, 2)) g
    LEFT JOIN (SELECT model, label, CASE WHEN label = 1 THEN p_fake ELSE p_real END AS p FROM predictions) q
      ON q.model = g.model AND q.label = g.label AND least(floor((q.p - g.low) / g.step), 19) = g.bin
    GROUP BY g.model, g.label, g.bin, g.low, g.step""")
oracle("model_comparison", "per_class", " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, {r(f"max({m}) FILTER (model = 'structure')", 'a')}, {r(f"max({m}) FILTER (model = 'text')", 'b')}
    FROM per_class WHERE class = 1""" for m in ("precision", "recall", "f1")))
oracle("feature_ratio", "ratios", f"""SELECT model, feature, {r('fake')}, {r('"real"')}, {r('ratio')} FROM ratios""")
oracle("relative_proportion", "ratios", f"""SELECT model, feature, {r('fake')}, {r('"real"')}, {r('ratio')},
    {r('fake / nullif(fake + "real", 0)', 'fake_share')}, {r('"real" / nullif(fake + "real", 0)', 'real_share')} FROM ratios""")
oracle("ratio_direction", "ratios", f"""SELECT model, feature, {r('fake')}, {r('"real"')}, {r('ratio')},
    CASE WHEN ratio > 1 THEN 'fake' ELSE 'real' END AS leans,
    CASE WHEN ratio > 0 THEN printf('%.2fx', ratio) ELSE 'N/A' END AS shown FROM ratios""")
oracle("feature_importance", "importance", f"SELECT model, feature, {rs('importance')}, {_RANK} FROM importance")
oracle("error_vs_correct", "predictions", f"""SELECT model, pred <> label AS is_error, count(*) AS cases,
    {', '.join(r(f'avg({f})', f) for f in FEATURES)} FROM predictions GROUP BY 1, 2""")
oracle("relative_gain", "runs", " UNION ALL ".join(
    f"""SELECT a.run, '{m}' AS metric, {r(f'a.{m}', 'base')}, {r(f'b.{m}', 'other')}, {r(f'b.{m} - a.{m}', 'gain')},
    {r(f'100 * (b.{m} - a.{m}) / nullif(a.{m}, 0)', 'gain_pct')} FROM runs a JOIN runs b ON b.run = a.run
    WHERE a.model = 'structure' AND b.model = 'text'""" for m in ("accuracy", "f1", "auc", "log_loss")))

# --- checks -----------------------------------------------------------------------------------

oracle("dangling_edges", "noisy tweets", """SELECT source, target, CASE WHEN s IS NULL AND t IS NULL THEN 'both ends unknown'
    WHEN s IS NULL THEN 'source unknown' WHEN t IS NULL THEN 'target unknown' ELSE 'two cascades' END AS reason FROM (
    SELECT e.source, e.target, a.news_id AS s, b.news_id AS t FROM noisy e
    LEFT JOIN tweets a ON a.tweet_id = e.source LEFT JOIN tweets b ON b.tweet_id = e.target)
    WHERE s IS NULL OR t IS NULL OR s <> t""")
oracle("duplicate_tweets", "", """SELECT l_orderkey || '_' || l_linenumber AS tweet_id, count(*) AS times FROM lineitem
    GROUP BY 1 HAVING count(*) > 1""")
oracle("time_violations", "noisy tweets", f"""SELECT e.source, e.target,
    {r('(epoch_us(s.timestamp) - epoch_us(t.timestamp)) / 1e6', 'seconds_early')} FROM noisy e
    JOIN tweets s ON s.tweet_id = e.source JOIN tweets t ON t.tweet_id = e.target WHERE t.timestamp < s.timestamp""")
oracle("label_conflicts", "docs", """SELECT news_id, count(DISTINCT label) AS labels, count(*) AS n_tweets FROM docs
    GROUP BY 1 HAVING count(DISTINCT label) > 1""")
