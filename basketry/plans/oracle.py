"""The results of ``queries.py`` in SQL, written the direct way: raw self-joins, global windows, full grids."""

from __future__ import annotations

from basketry.plans.queries import KS, MAX_K, TRAIN_SAMPLE, VALIDATION_SAMPLE

K_LIST = ", ".join(str(k) for k in KS)
INTERACTION = "pid, pos, track_id, artist_id, album_id, duration_ms"
LAST = "9223372036854775807"
# Shares and gains are summed as whole numbers of this part of one.
UNITS = "1e12::DOUBLE"


def _units(share: str) -> str:
    return f"round(({share})::DOUBLE * {UNITS})::DECIMAL(20,0)"


IDEAL = f"(SELECT sum({_units('1 / log2(r + 1)')})::DOUBLE / {UNITS} FROM range(1, 1000) ideal(r) WHERE r <= k AND r <= target_count)"


def _score(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % 1000000)"


def _label(length: str, pid: str, minimum: int, train: str, validation: str) -> str:
    score = f"{_score(f"'42|' || {pid}")} / 1000000.0::DOUBLE"
    return (
        f"CASE WHEN {length} < {minimum} OR {score} < {train}::DOUBLE THEN 'train' "
        f"WHEN {score} < {validation}::DOUBLE THEN 'validation' ELSE 'test' END"
    )


CTES = {
    "purchases": """
        SELECT o_custkey AS pid, l.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey,
            l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos
        FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""",
    # Nested documents, already flat: one row per item with the fields as they stand in the JSON.
    "document_items": """
        SELECT CASE WHEN c_acctbal >= -900 THEN c_custkey END AS pid, c_custkey, pos // 1000 AS chunk,
            CASE WHEN l_returnflag = 'R' THEN ' ' ELSE '' END || 'x:part:' || l_partkey
                || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ' ' ELSE '' END AS track_uri,
            CASE WHEN l_returnflag = 'N' THEN '  ' ELSE '' END || p_name AS track_name,
            CASE WHEN l_quantity <= 40 THEN 'x:supplier:' || l_suppkey END AS artist_uri,
            CASE WHEN l_returnflag <> 'A' THEN 'Supplier ' || l_suppkey END AS artist_name,
            'x:brand:' || CASE WHEN l_linestatus = 'O' THEN '' ELSE p_brand END AS album_uri,
            CASE WHEN l_discount < 0.03::DOUBLE THEN '   ' ELSE p_brand END AS album_name,
            l_quantity::BIGINT AS duration_ms, CASE WHEN l_tax < 0.08::DOUBLE THEN pos END AS pos
        FROM purchases p JOIN customer ON p.pid = c_custkey JOIN part ON l_partkey = p_partkey""",
    "document_collections": """
        SELECT c.*, coalesce(chunk, 0) AS chunk, coalesce(items, 0) AS items, duration
        FROM customer c LEFT JOIN (SELECT pid, pos // 1000 AS chunk, count(*) AS items,
            sum(l_quantity::BIGINT) AS duration FROM purchases GROUP BY ALL) ON c_custkey = pid""",
    "cleaned_items": """
        SELECT pid, c_custkey, pos, duration_ms, trim(track_uri, ' ') AS track_uri,
            regexp_extract(track_uri, '([^:]+)$', 1) AS track_id, trim(track_name, ' ') AS track_name,
            artist_uri, regexp_extract(artist_uri, '([^:]+)$', 1) AS artist_id, artist_name, album_uri,
            nullif(regexp_extract(album_uri, '([^:]+)$', 1), '') AS album_id,
            nullif(trim(album_name, ' '), '') AS album_name
        FROM document_items""",
    "baskets": """
        SELECT pid, pos, l_partkey AS track_id, l_suppkey AS artist_id, p_brand AS album_id,
            l_quantity::BIGINT AS duration_ms
        FROM purchases JOIN part ON l_partkey = p_partkey""",
    "lengths": """
        SELECT c_custkey AS pid, coalesce(n, 0) AS playlist_length
        FROM customer LEFT JOIN (SELECT pid, count(*) AS n FROM baskets GROUP BY pid) ON c_custkey = pid""",
    "splits": f"""
        SELECT pid, split, playlist_length, split IN ('validation', 'test') AS eligible_for_eval
        FROM (SELECT *, {_label("playlist_length", "pid", 5, "0.9", "0.9500000000000001")} AS split FROM lengths)""",
    "budget": """
        SELECT pid, split, playlist_length,
            least(10, greatest(1, ceil(playlist_length * 0.2::DOUBLE)))::INTEGER AS hidden_count
        FROM splits WHERE eligible_for_eval""",
    "scored": f"""
        SELECT b.*, split, hidden_count, {_score("'42|' || split || '|' || b.pid || '|' || pos")} AS mask_score
        FROM baskets b JOIN budget USING (pid)""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY pid ORDER BY mask_score, pos) AS mask_rank FROM scored""",
    "train": f"SELECT {INTERACTION} FROM baskets WHERE pid IN (SELECT pid FROM splits WHERE split = 'train')",
    "context": f"SELECT {INTERACTION} FROM ranked WHERE split = 'validation' AND mask_rank > hidden_count",
    "targets": f"SELECT {INTERACTION} FROM ranked WHERE split = 'validation' AND mask_rank <= hidden_count",
    "popularity": """
        SELECT track_id, train_frequency,
            row_number() OVER (ORDER BY train_frequency DESC, track_id) AS popularity_rank
        FROM (SELECT track_id, count(*) AS train_frequency FROM train GROUP BY track_id)""",
    "pool": f"""
        SELECT * FROM popularity WHERE popularity_rank <= {MAX_K + 50} + coalesce(
            (SELECT max(n) FROM (SELECT count(DISTINCT track_id) AS n FROM context GROUP BY pid)), 0)""",
    "popular": f"""
        SELECT 'popularity' AS baseline_name, pid, rank::INTEGER AS rank, track_id, train_frequency::DOUBLE AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY popularity_rank) AS rank
            FROM (SELECT DISTINCT pid FROM context) p, pool
            WHERE NOT EXISTS (FROM context c WHERE c.pid = p.pid AND c.track_id = pool.track_id))
        WHERE rank <= {MAX_K}""",
    "pairs": """
        SELECT a.track_id AS context_track_id, b.track_id AS candidate_track_id, count(*) AS pair_support,
            train_frequency AS candidate_popularity
        FROM train a JOIN train b ON a.pid = b.pid AND a.track_id <> b.track_id
            JOIN popularity p ON p.track_id = b.track_id
        WHERE train_frequency >= 5 GROUP BY ALL HAVING count(*) >= 3""",
    "cooccurring": f"""
        SELECT 'cooccurrence' AS baseline_name, pid, rank::INTEGER AS rank, track_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY pid
                ORDER BY score DESC, candidate_popularity DESC, track_id) AS rank
            FROM (SELECT pid, candidate_track_id AS track_id, sum(pair_support)::DOUBLE AS score,
                    max(candidate_popularity) AS candidate_popularity
                FROM context JOIN pairs ON track_id = context_track_id GROUP BY ALL) s
            WHERE NOT EXISTS (FROM context c WHERE c.pid = s.pid AND c.track_id = s.track_id))
        WHERE rank <= {MAX_K}""",
    "recommendations": "FROM popular UNION ALL FROM cooccurring",
    "relevant": "SELECT DISTINCT pid, track_id FROM targets",
    "target_counts": "SELECT pid, count(*) AS target_count FROM relevant GROUP BY pid",
    "hits": f"""
        SELECT baseline_name, r.pid, k, sum(CASE WHEN v.pid IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS hit_count,
            sum(CASE WHEN v.pid IS NULL THEN 0 ELSE {_units("1 / log2(rank + 1)")} END)::DOUBLE / {UNITS} AS dcg
        FROM recommendations r JOIN unnest([{K_LIST}]) cutoffs(k) ON rank <= k
            LEFT JOIN relevant v ON v.pid = r.pid AND v.track_id = r.track_id
        GROUP BY ALL""",
    "metrics": f"""
        SELECT baseline_name, k,
            sum({_units("coalesce(hit_count, 0) / target_count")})::DOUBLE / (count(*) * {UNITS}) AS recall,
            sum({_units("coalesce(hit_count, 0) / k")})::DOUBLE / (count(*) * {UNITS}) AS precision,
            sum({_units(f"coalesce(dcg, 0) / {IDEAL}")})::DOUBLE / (count(*) * {UNITS}) AS ndcg
        FROM (FROM target_counts, unnest(['popularity', 'cooccurrence']) names(baseline_name),
            unnest([{K_LIST}]) cutoffs(k)) LEFT JOIN hits USING (baseline_name, pid, k)
        GROUP BY ALL""",
}


def _sql(select: str, **replaced: str) -> str:
    """``select`` over the common tables, some of them replaced."""
    steps = CTES | replaced
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in _needed(select, steps)) + "\n" + select


def _needed(select: str, steps: dict[str, str]) -> list[tuple[str, str]]:
    wanted, text = [], select
    for name, body in reversed(steps.items()):
        if f" {name}" in text:
            wanted.insert(0, (name, body))
            text += body
    return wanted


def _sample(pids: str, name: str, size: int) -> str:
    return f"SELECT pid FROM (SELECT DISTINCT pid FROM {pids}) ORDER BY {_score(f"'42|{name}|' || pid")}, pid LIMIT {size}"


def _plain(body: str) -> str:
    return body.strip()


EVENTS = "SELECT user_id AS pid, (props->>'$.k')::BIGINT AS track_id FROM events"
ORDERS = "SELECT l_orderkey AS pid, l_partkey AS track_id FROM lineitem"
ALL_BASKETS = f"SELECT {INTERACTION} FROM baskets"
PAIRS = "SELECT context_track_id, candidate_track_id, pair_support, candidate_popularity FROM pairs"
POPULARITY = "SELECT track_id, train_frequency, popularity_rank FROM popularity"


def _first(attribute: str) -> str:
    return (
        f"first({attribute} ORDER BY coalesce(pid, {LAST}), coalesce(pos, {LAST}), {attribute}) "
        f"FILTER (WHERE {attribute} IS NOT NULL) AS {attribute}"
    )


def oracle_sql() -> dict[str, str]:
    attributes = (
        "track_id", "track_name", "artist_uri", "artist_id", "artist_name",
        "album_uri", "album_id", "album_name", "duration_ms",
    )
    name = "CASE WHEN c_nationkey = 0 THEN '  ' WHEN c_nationkey < 5 THEN '  ' || c_name || ' ' ELSE c_name END"
    sampled = _sample(f"({CTES['context']})", "validation", VALIDATION_SAMPLE)
    return {
        "scan_nested_json": _sql(f"""
            SELECT 7::INTEGER AS slice_start, 1006::INTEGER AS slice_end,
                CASE WHEN c_acctbal >= -900 THEN c_custkey END AS pid, {name} AS name, items AS num_tracks,
                items::INTEGER AS items, coalesce(duration, 0)::BIGINT AS duration FROM document_collections"""),
        "flatten_collections": _sql(f"""
            SELECT c_custkey AS pid, nullif(trim({name}, ' '), '') AS name,
                CASE WHEN c_nationkey < 8 THEN true WHEN c_nationkey < 16 THEN false END AS collaborative,
                NULL::BIGINT AS modified_at, NULL::BIGINT AS num_albums, NULL::BIGINT AS num_artists,
                NULL::BIGINT AS num_edits, c_nationkey::BIGINT AS num_followers, items AS num_tracks,
                NULL::BIGINT AS duration_ms,
                format('mpd.slice.{{}}-{{}}.{{}}.json', c_custkey // 1000 * 1000, c_custkey // 1000 * 1000 + 999, chunk)
                    AS source_file,
                (c_custkey // 1000 * 1000)::INTEGER AS slice_start,
                (c_custkey // 1000 * 1000 + 999)::INTEGER AS slice_end
            FROM document_collections WHERE c_acctbal >= -900"""),
        "item_dimension": _sql(f"""
            SELECT track_uri, {", ".join(_first(a) for a in attributes)} FROM cleaned_items GROUP BY track_uri"""),
        "flatten_interactions": _sql("""
            SELECT pid, pos::BIGINT AS pos, track_uri, track_id, artist_uri, artist_id, album_uri, album_id, duration_ms
            FROM cleaned_items WHERE pid IS NOT NULL AND pos IS NOT NULL"""),
        "clean_text": _plain("""
            SELECT 'customer' AS source, c_custkey AS id, c_name || chr(9) AS cleaned FROM customer
            UNION ALL SELECT 'part', p_partkey, CASE WHEN p_size <= 25 THEN trim(p_name, ' ') END FROM part
            UNION ALL SELECT 'documents', doc_id, nullif(trim(text, ' '), '') FROM documents"""),
        "last_segment_id": _plain("""
            SELECT page_id AS id, url, nullif(regexp_extract(url, '([^/]+)$', 1), '') AS segment FROM pages
            UNION ALL SELECT p_partkey, ' x:part:' || CASE WHEN p_size > 5 THEN p_name ELSE '' END,
                CASE WHEN p_size > 5 THEN p_name END FROM part"""),
        "source_slice_range": _plain("""
            SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::INTEGER END AS slice_start,
                CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey + 999)::INTEGER END AS slice_end FROM orders"""),
        "write_tables": _plain("""
            SELECT c_custkey AS pid, c_name AS name, NULL::BIGINT AS num_tracks, (SELECT count(*) FROM lineitem) AS items
            FROM customer"""),
        "load_layer": _plain("""
            SELECT 'customer' AS "table", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
            UNION ALL SELECT 'lineitem', count(*) FROM lineitem"""),
        "collection_lengths": _sql("SELECT pid, playlist_length FROM lengths"),
        "hash_split": _sql("SELECT pid, split, playlist_length, eligible_for_eval FROM splits"),
        "hash_split_orders": _sql(
            "SELECT pid, split, playlist_length, eligible_for_eval FROM splits",
            lengths="""SELECT o_orderkey AS pid, coalesce(n, 12) AS playlist_length FROM orders
                LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
        ),
        "train_interactions": _sql(f"SELECT {INTERACTION} FROM train"),
        "holdout_budget": _sql("SELECT pid, split, playlist_length, hidden_count FROM budget"),
        "holdout_rank": _sql(f"SELECT {INTERACTION}, split, hidden_count, mask_score, mask_rank FROM ranked"),
        "holdout_conversations": _sql(
            "SELECT pid, pos, track_id, split, hidden_count, mask_rank FROM ranked",
            baskets="SELECT conv_id AS pid, turn AS pos, role AS track_id FROM conversations",
            lengths="SELECT pid, count(*) AS playlist_length FROM baskets GROUP BY pid",
            splits=f"""SELECT *, split <> 'train' AS eligible_for_eval FROM (
                SELECT *, {_label("playlist_length", "pid", 3, "0.5", "0.8")} AS split FROM lengths)""",
            budget="""SELECT pid, split, least(2, greatest(1, ceil(playlist_length * 0.3::DOUBLE)))::INTEGER
                AS hidden_count FROM splits WHERE eligible_for_eval""",
        ),
        "holdout_context": _sql(f"SELECT {INTERACTION} FROM context"),
        "holdout_targets": _sql(f"SELECT {INTERACTION} FROM targets"),
        "split_counts": _sql("SELECT split, count(*) AS playlists FROM splits GROUP BY split"),
        "split_summary": _sql("""
            SELECT count(*) FILTER (split = 'train') AS train_playlists,
                count(*) FILTER (split = 'validation') AS validation_playlists,
                count(*) FILTER (split = 'test') AS test_playlists,
                count(*) FILTER (eligible_for_eval) AS eligible_eval_playlists FROM splits"""),
        "sample_collections": _sample("(SELECT o_custkey AS pid FROM orders JOIN lineitem ON l_orderkey = o_orderkey)", "train", TRAIN_SAMPLE),
        "sample_collections_histogram": _sample("(SELECT l_orderkey AS pid FROM lineitem)", "train", 10_000),
        "restrict_run_tables": _sql(f"""
            SELECT {INTERACTION}, 'train' AS run_table FROM train
                WHERE pid IN ({_sample("train", "train", TRAIN_SAMPLE)})
            UNION ALL SELECT {INTERACTION}, 'context' FROM context
                WHERE pid IN ({_sample("context", "validation", VALIDATION_SAMPLE)})
            UNION ALL SELECT {INTERACTION}, 'targets' FROM targets
                WHERE pid IN ({_sample("context", "validation", VALIDATION_SAMPLE)})"""),
        "item_popularity": _sql(POPULARITY, train=ALL_BASKETS),
        "item_popularity_events": _sql(POPULARITY, train=EVENTS),
        "popularity_candidates": _sql("SELECT track_id, train_frequency, popularity_rank FROM pool"),
        "recommend_popular": _sql("SELECT * FROM popular"),
        "recommend_popular_events": _sql("SELECT * FROM popular", train=EVENTS, context=EVENTS),
        "cooccurrence_pairs": _sql(PAIRS, train=ALL_BASKETS),
        "cooccurrence_pairs_orders": _sql(PAIRS, train=ORDERS),
        "cooccurrence_pairs_events": _sql(PAIRS, train=EVENTS),
        "recommend_cooccurrence": _sql("SELECT * FROM cooccurring"),
        "recommendations_union": _sql("SELECT * FROM recommendations"),
        "ideal_dcg": _plain(f"""
            SELECT target_count, k, sum({_units("1 / log2(r + 1)")})::DOUBLE / {UNITS} AS idcg
            FROM (SELECT DISTINCT count(DISTINCT l_partkey) AS target_count FROM lineitem GROUP BY l_orderkey),
                unnest([1, 3, {K_LIST}]) cutoffs(k), range(1, 101) ideal(r)
            WHERE r <= target_count AND r <= k GROUP BY ALL"""),
        "hits_and_dcg": _sql(f"SELECT baseline_name, pid, k, hit_count, dcg FROM hits"),
        "ranking_metrics": _sql(f"SELECT baseline_name, k, recall, precision, ndcg FROM metrics"),
        "metrics_report": _sql(" UNION ALL ".join(
            f"SELECT baseline_name, '{label}@' || k AS metric, {m} AS value FROM metrics"
            for m, label in (("recall", "Recall"), ("precision", "Precision"), ("ndcg", "NDCG"))
        )),
        "ingest_summary": _sql("""
            SELECT count(DISTINCT (c_custkey // 1000, chunk)) AS input_file_count, 0::BIGINT AS corrupt_files,
                count(*) AS playlists_read, sum(items)::BIGINT AS items_read,
                (SELECT count(*) FROM document_items WHERE pid IS NULL OR pos IS NULL) AS dropped_interactions
            FROM document_collections"""),
        "run_summary": _sql("""
            SELECT true AS full_data_mode, count(DISTINCT pid) AS sampled_train_playlists,
                (SELECT count(DISTINCT pid) FROM context) AS sampled_validation_playlists FROM train"""),
        "end_to_end": _sql(f"SELECT baseline_name, k, recall, precision, ndcg FROM metrics"),
        "end_to_end_sampled": _sql(
            f"SELECT baseline_name, k, recall, precision, ndcg FROM metrics",
            train=f"SELECT * FROM ({CTES['train']}) WHERE pid IN ({_sample(f'({CTES["train"]})', 'train', TRAIN_SAMPLE)})",
            context=f"SELECT * FROM ({CTES['context']}) WHERE pid IN ({sampled})",
            targets=f"SELECT * FROM ({CTES['targets']}) WHERE pid IN ({sampled})",
        ),
        "end_to_end_documents": _sql(
            f"SELECT baseline_name, k, recall, precision, ndcg FROM metrics",
            baskets="SELECT pid, pos, track_id, artist_id, album_id, duration_ms FROM cleaned_items WHERE pid IS NOT NULL AND pos IS NOT NULL",
            lengths="""SELECT c_custkey AS pid, coalesce(n, items) AS playlist_length FROM document_collections
                LEFT JOIN (SELECT pid, count(*) AS n FROM baskets GROUP BY pid) b ON c_custkey = b.pid
                WHERE c_acctbal >= -900""",
        ),
    }
