"""The same results as the queries, as SQL over the same tables."""

from __future__ import annotations

from quern.operators import jobs, text, traces
from quern.plans import queries as Q
from quern.plans.views import FIRST_CENTROIDS, with_views

WORDS = r"string_split_regex({0}, '[ \t\n\r\f]+')"

LINES = r"""
    select doc_id, source, cast(unnest(range(len(parts))) as int) as line_no, unnest(parts) as line
    from (select doc_id, source, string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') as parts
          from documents where text <> '')"""

UNIFORM = "(cast('0x' || substr(md5('0:{draw}:' || cast({key} as varchar)), 1, 13) as bigint) / 4503599627370496.0)"


def uniform(draw: str, key: str = "job_id") -> str:
    return UNIFORM.format(draw=draw, key=key)


def gaussian(draw: str, mean: float, deviation: float, key: str = "job_id") -> str:
    radius = f"sqrt(-2.0 * ln(1 - {uniform(draw + '.r', key)}))"
    return f"({mean} + {deviation} * {radius} * cos(2.0 * pi() * {uniform(draw + '.a', key)}))"


def not_negative(draw: str, mean: float, deviation: float) -> str:
    tries = [gaussian(f"{draw}{i}", mean, deviation) for i in range(3)]
    kept = [f"case when {t} >= 0 then {t} end" for t in tries[:-1]]
    return f"coalesce({', '.join(kept)}, abs({tries[-1]}))"


SENSITIVITY = f"""
    case when utility_type = 1 then
        case deadline_type
            when 0 then case when beta > -1 and beta <= -0.7 then beta else -(0.7 + 0.3 * {uniform('hard')}) end
            when 1 then case when beta >= -0.3 and beta < -0.1 then beta else -(0.1 + 0.3 * {uniform('soft')}) end
            else 0 end
    else
        case deadline_type
            when 0 then case when beta >= 2.5 then beta else {not_negative('hard', 5.0, 0.5)} end
            when 1 then case when beta > 0 and beta <= 1 then beta else {not_negative('soft', 0.04, 0.005)} end
            else 0 end
    end"""


def utility(finish: str) -> str:
    delay = f"({finish} - deadline)"
    return (
        f"case when utility_type = 1 then case when {delay} < 0 then sensitivity * {delay} + priority else 0 end "
        f"else priority * (1 / (1 + exp(sensitivity * {delay})) - 1) - 1 end"
    )


def readable(finish: str) -> str:
    delay = f"({finish} - deadline)"
    return (
        f"case when utility_type = 1 then case when {delay} < 0 then sensitivity * {delay} + priority else 0 end "
        f"when deadline_type = 2 then 0 else priority * (1 / (1 + exp(sensitivity * {delay})) - 0.5) end"
    )


DEMAND = f"(rem_map * floor(est_map / {jobs.STEP}) + rem_red * floor(est_red / {jobs.STEP}))"
DELAY = f"(ceil({DEMAND} / {jobs.CAPACITY}.0) * {jobs.STEP}.0)"

def block_of(member: str) -> str:
    """The block of a member among ``blocks``."""
    return f"cast(case when blocks > 1 then cast('0x' || substr(md5({member}), 1, 15) as bigint) % blocks else 0 end as int)"


def blocks_over(group: str) -> str:
    return f"ceil(count(*) over (partition by {group}) / {float(Q.LIST_ROWS)})::bigint"


def round2(x: str) -> str:
    """Two places of the exact binary value, ties to even, as printing gives them."""
    return f"(cast(printf('%.2f', {x}) as double) + 0.0)"


SUMMARY = """
    select snapshot_id, {0} as min_utility, {1} as total_utility, {2} as min_readable, {3} as total_readable
    from scored group by snapshot_id""".format(*[round2(x) for x in ("min(u)", "fsum(u)", "min(r)", "fsum(r)")])


def backlog(rank: str, source: str = "job_snapshots") -> dict[str, str]:
    return {
        "run": f"select *, sum({DELAY}) over (partition by snapshot_id order by {rank}, job_id rows unbounded preceding) as finish from {source}",
        "scored": f"select snapshot_id, {utility('finish')} as u, {readable('finish')} as r from run",
    }


def inverted_time(u: str) -> str:
    inside = f"greatest(least({u}, 0.9995 * priority), (1 - 0.9995) * priority)"
    log_odds = f"ln(priority / {inside} - 1)"
    return (
        f"case when sensitivity = 0 then case when {log_odds} > 0 then 'inf'::double else '-inf'::double end "
        f"else {log_odds} / sensitivity + deadline end"
    )


DECAY = "(case when utility_type = 1 then sensitivity else -priority * sensitivity / 4 end)"
REWARDS = {
    "prepared": f"""
        select *, {readable('0.0')} as yield, cast({DECAY} as decimal(38, 12)) as decay,
               est_map * ceil(rem_map / 40.0) + est_red * ceil(rem_red / 40.0) as remaining,
               case when utility_type = 1 then 'inf'::double else {inverted_time('0.0')} end as expire
        from job_snapshots""",
    "totals": "select snapshot_id, sum(decay) as total from prepared group by 1",
    "rewarded": """
        select p.*, (0.3 * (yield / (1 + 9.0 * remaining))
                     + (1 - 0.3) * (cast(total as double) - cast(decay as double)) * least(remaining, expire)) / remaining as reward
        from prepared p join totals using (snapshot_id)""",
}

SIMILARITY = """
    select r.movie_id, c.k, cast(sum(r.rating * c.c_rating) as float)
           / cast(sqrt(sum(r.rating * r.rating)) * sqrt(sum(c.c_rating * c.c_rating)) as float) as similarity
    from {reviews} r join {centroids} c using (rater_id) group by 1, 2"""


def assign(centroids: str, suffix: str = "") -> dict[str, str]:
    return {
        f"scores{suffix}": SIMILARITY.format(reviews="ratings", centroids=centroids),
        f"best{suffix}": f"select movie_id, k, similarity from scores{suffix} where similarity > 0 "
        "qualify row_number() over (partition by movie_id order by similarity desc, k) = 1",
        f"assigned{suffix}": "select m.movie_id, coalesce(k, 0) as cluster, coalesce(similarity, cast(0 as float)) as similarity "
        f"from (select distinct movie_id from ratings) m left join best{suffix} b on m.movie_id = b.movie_id",
    }


def review_lists(winners: str, suffix: str = "") -> dict[str, str]:
    """All reviews of each winner by (rater_id, rating)."""
    return {
        f"kept{suffix}": f"""
            select w.*, rater_id, rating, concat(cast(rater_id as varchar), '_', cast(rating as varchar)) as token,
                   row_number() over (partition by cluster order by rater_id, rating) as place
            from ratings join {winners} w using (movie_id)""",
        f"model{suffix}": f"""
            select cluster as k, similarity, movie_id, total, cast((place - 1) // {Q.MODEL_ROWS} * {Q.MODEL_ROWS} as int) as start,
                   string_agg(token, ',' order by place) as reviews, any_value(members) as members
            from (select *, cast(count(*) over (partition by cluster) as int) as total from kept{suffix})
            group by cluster, similarity, movie_id, total, start""",
        f"centroids{suffix}": f"""
            select cast(dense_rank() over (order by movie_id desc) - 1 as int) as k, rater_id, c_rating from (
                select movie_id, rater_id, arg_min(rating, place) as c_rating from kept{suffix} group by 1, 2)""",
    }


def update(suffix: str = "") -> dict[str, str]:
    return {
        f"averages{suffix}": f"select cluster, cast(avg(similarity) as float) as average, count(*) as members from assigned{suffix} group by 1",
        f"winners{suffix}": f"""
            select cluster, members, movie_id, similarity from assigned{suffix} join averages{suffix} using (cluster)
            qualify row_number() over (partition by cluster order by abs(average - similarity), movie_id) = 1""",
        **review_lists(f"winners{suffix}", suffix),
    }


FIRST_MODEL = {
    "chosen": "select cast(row_number() over (order by movie_id desc) - 1 as int) as cluster, cast(0 as bigint) as members, "
    f"movie_id, cast(0 as float) as similarity from (select unnest({list(FIRST_CENTROIDS)}) as movie_id)",
    **review_lists("chosen", "_start"),
}


def kmeans_passes() -> tuple[dict[str, str], str]:
    steps, centroids = dict(FIRST_MODEL), "centroids_start"
    for i in range(Q.KMEANS_PASSES):
        steps |= assign(centroids, f"_{i}")
        steps |= update(f"_{i}")
        centroids = f"centroids_{i}"
    last = Q.KMEANS_PASSES - 1
    before = f"winners_{last - 1}" if last else "chosen"
    steps["settled"] = f"""
        select not exists (from winners_{last} anti join {before} using (movie_id))
               and not exists (from {before} anti join winners_{last} using (movie_id)) as settled"""
    return steps, f"model_{Q.KMEANS_PASSES - 1}"


PASSES, LAST_MODEL = kmeans_passes()

TERA = {
    "bits": """
        select 0 as b, 3141592621::hugeint as a, 663896637::hugeint as c
        union all select b + 1, (a * a) % 4294967296, (c * (a + 1)) % 4294967296 from bits where b < 31""",
    "walk": """
        select o_orderkey as row_id, 0 as b, 0::hugeint as s from orders
        union all
        select row_id, w.b + 1, case when ((3 * row_id) >> w.b) % 2 = 1 then (a * s + c) % 4294967296 else s end
        from walk w join bits on w.b = bits.b""",
    "draws": """
        select row_id, s1, s2, (s2 * 3141592621 + 663896637) % 4294967296 as s3 from (
            select row_id, s1, (s1 * 3141592621 + 663896637) % 4294967296 as s2 from (
                select row_id, (s * 3141592621 + 663896637) % 4294967296 as s1 from walk where b = 32))""",
    "rows": "select row_id, substr(concat({parts}), 1, 10) as key, concat(lpad(cast(row_id as varchar), 10, ' '), {filler}) as value from draws".format(
        parts=", ".join(
            f"chr(cast(32 + ((s{i} // 52) // {95**p}) % 95 as int))" for i in (1, 2, 3) for p in (3, 2, 1, 0)
        ),
        filler=", ".join(
            f"repeat(chr(cast(65 + (row_id * 8 % 26 + {i}) % 26 as int)), {n})" for i, n in enumerate((10,) * 7 + (8,))
        ),
    ),
}

SPLITS = {
    "sample": f"select key from rows where {uniform('split', 'value')} < {float(Q.SPLIT_SAMPLE)} / (select count(*) from rows)",
    "ranked": "select key, row_number() over (order by key) - 1 as place, count(*) over () as n from sample",
    "splits": f"""
        select cast(i as int) as split, key from range(1, {Q.SORT_PARTS}) t(i)
        join ranked on floor(i * (n / {float(Q.SORT_PARTS)}) + 0.5) = place""",
}


def tera(body: str, steps: dict[str, str] | None = None) -> str:
    return with_views([], body, {**TERA, **(steps or {})})


PROFILE = """
    100 + o_orderkey % 90 as map_tasks, 10 + o_orderkey % 11 as red_tasks"""

EVENT_BURSTS = """
    select {keys} burst_start, burst_end, changes from (
        select {keys} burst, epoch_us(min(ts)) as burst_start, epoch_us(max(ts) + interval {gap}) as burst_end, count(*) as changes
        from (select *, sum(starts) over ({part} order by ts) as burst
              from (select *, case when lag(ts) over ({part} order by ts) + interval {gap} >= ts then 0 else 1 end as starts
                    from task_events))
        group by {keys} burst)"""

REVIEW_FAULTS = {
    "lined": r"""
        select value, case when strpos(value, ':') <= 1 then 'no movie'
                           when not regexp_full_match(split_part(value, ':', 1), '[+-]?[0-9]+') then 'movie is no number' end as line_reason
        from mixed_lines""",
    "listed": """
        select split_part(value, ':', 1) as movie, cast(unnest(range(len(parts))) as int) as pos, unnest(parts) as token
        from (select value, string_split(split_part(value, ':', 2), ',') as parts from lined where line_reason is null)""",
    "judged": r"""
        select *, case when not contains(token, '_') then 'no rater'
                       when not regexp_full_match(split_part(token, '_', 1), '[+-]?[0-9]+') then 'rater is no number'
                       when not regexp_full_match(split_part(token, '_', 2), '[+-]?[0-9]+') or try_cast(split_part(token, '_', 2) as int) is null
                           then 'rating is no number' end as reason
        from listed""",
}

EDGE_COUNTS = f"""
    select count(*) as lines, count(*) filter (contains(line, ',')) as edges, count(*) filter (not contains(line, ',')) as malformed,
           count(*) filter (contains(line, ',')) as written
    from ({LINES})"""

ESTIMATE = "cast(m + (10 - m % 10) as double)"


def _class_case(values: list) -> str:
    arms = " ".join(f"when {i} then {v!r}" for i, v in enumerate(values))
    return f"case cast(floor({uniform('class')} * {len(values)}) as int) {arms} end"


ORACLES: dict[str, str] = {
    "text_source": f"select doc_id, line_no, line from ({LINES})",
    "tokenize": f"select doc_id, len(list_filter({WORDS.format('text')}, lambda w: w <> '')) as n_tokens from documents",
    "word_count": f"select word, count(*) as n from (select unnest({WORDS.format('text')}) as word from documents) where word <> '' group by word",
    "sequence_count": f"""
        with words as (select source, list_filter({WORDS.format('line')}, lambda w: w <> '') as w from ({LINES})),
        places as (select source, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)
        select w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, source as doc, count(*) as n from places group by 1, 2, 3, 4""",
    "inverted_index": f"select distinct word, doc from (select unnest({WORDS.format('text')}) as word, doc_id as doc from documents) where word <> ''",
    "inverted_index_list": f"""
        select word, {block_of('cast(doc as varchar)')} as block, count(*) as n_docs, string_agg(cast(doc as varchar), ',' order by doc) as docs
        from (select *, {blocks_over('word')} as blocks from (
            select distinct word, doc from (select unnest({WORDS.format('text')}) as word, doc_id as doc from documents) where word <> ''))
        group by 1, 2""",
    "term_vector": f"""
        select source as host, word, count(*) as n, concat(word, ':', cast(count(*) as varchar)) as term
        from (select source, unnest({WORDS.format('text')}) as word from documents) where word <> ''
        group by 1, 2 having count(*) >= {text.TERM_CUTOFF}""",
    "movie_source": with_views(
        ["movie_lines"],
        """
        select cast(split_part(value, ':', 1) as bigint) as movie_id, cast(i - 1 as int) as pos,
               case when contains(t, '_') then cast(split_part(t, '_', 1) as int) end as rater_id,
               cast(case when contains(t, '_') then split_part(t, '_', 2) else t end as int) as rating
        from (select value, i, split_part(split_part(value, ':', 2), ',', cast(i as int)) as t from movie_lines, range(1, 4) r(i))""",
    ),
    "parse_reviews": with_views(
        ["movie_lines"],
        """
        select cast(split_part(value, ':', 1) as bigint) as movie_id, cast(i - 1 as int) as pos,
               cast(split_part(t, '_', 1) as int) as rater_id, cast(split_part(t, '_', 2) as int) as rating
        from (select value, i, split_part(split_part(value, ':', 2), ',', cast(i as int)) as t from movie_lines, range(1, 4) r(i))
        where contains(t, '_')""",
    ),
    "bad_rows": with_views(
        ["mixed_lines"],
        "select movie, pos, token, reason from judged where reason is not null union all select null, null, value, line_reason from lined where line_reason is not null",
        REVIEW_FAULTS,
    ),
    "good_rows": with_views(
        ["mixed_lines"],
        """
        select cast(movie as bigint) as movie_id, pos, cast(split_part(token, '_', 1) as int) as rater_id, cast(split_part(token, '_', 2) as int) as rating
        from judged where reason is null""",
        REVIEW_FAULTS,
    ),
    "edge_source": f"""
        select array_to_string(parts[:len(parts) - 1], ',') as src, parts[len(parts)] as dst
        from (select string_split(line, ',') as parts from ({LINES})) where len(parts) > 1""",
    "malformed_edges": EDGE_COUNTS,
    "stream_malformed_edges": EDGE_COUNTS,
    "itemset_source": f"""
        select array_to_string(parts[:len(parts) - 1], ',') as prefix, parts[len(parts)] as item
        from (select string_split(line, ',') as parts from ({LINES})) where len(parts) > 1""",
    "tera_source": f"select substr(hex(encode(line)), 1, 20) as key_hex, greatest(strlen(line) - 10, 0) as value_bytes from ({LINES})",
    "job_profile_source": """
        select cast(100 + o_orderkey % 90 as int) as map_tasks, cast(10 + o_orderkey % 11 as int) as red_tasks,
               200 + o_orderkey % 997 + 0.5::double as deadline, o_orderkey % 10007 + 0.25::double as join_time,
               cast(1 + o_orderkey % 5 as double) as priority, cast(o_orderkey % 3 as int) as deadline_type,
               cast(0 as int) as utility_type, 0.04::double as sensitivity,
               concat('jobs.', substr(o_orderstatus, 1, 1)) as job_class, concat('job', cast(o_orderkey as varchar)) as job_name
        from orders""",
    "result_log_source": """
        select o_totalprice as exec_time, o_orderkey % 313 + 0.5::double as latency, 0.5::double as utility_readable,
               -0.25::double as utility, cast(o_custkey % 10 as varchar) as queue_id, cast(100 as int) as map_tasks, cast(20 as int) as red_tasks,
               cast(200 + o_orderkey % 997 as double) as deadline, o_orderkey % 10007 + 0.25::double as join_time,
               3.0::double as priority, cast(1 as int) as deadline_type, cast(0 as int) as utility_type, 0.04::double as sensitivity,
               'jobs.WordCount' as job_class, concat('job', cast(o_orderkey as varchar)) as job_name
        from orders where o_orderstatus <> 'P'""",
    "histogram_ratings": with_views(["ratings"], "select rating, count(*) as n from ratings group by rating"),
    "histogram_movies": with_views(
        ["ratings"],
        """
        select floor(cast(cast(a as float) as double) * 2) / 2 + 0.5 as bin, count(*) as n
        from (select sum(rating) / cast(count(*) as double) as a from ratings group by movie_id) group by 1""",
    ),
    "histogram_movies_lines": with_views(
        ["movie_lines"],
        """
        select floor(cast(cast(a as float) as double) * 2) / 2 + 0.5 as bin, count(*) as n
        from (select (l_linenumber + cast(l_quantity as int) + l_linenumber) / 3.0::double as a from lineitem) group by 1""",
    ),
    "load_centroids": with_views(["ratings"], "select k, rater_id, cast(c_rating as int) as c_rating from centroids_start", FIRST_MODEL),
    "cosine_scores": with_views(
        ["ratings", "centroids"],
        "select movie_id, k, round(cast(similarity as double), 5) as similarity from scores",
        assign("centroids"),
    ),
    "classify": with_views(["ratings", "centroids"], "select movie_id, cluster from assigned", assign("centroids")),
    "kmeans_assign": with_views(
        ["ratings", "centroids"],
        "select movie_id, cluster, round(cast(similarity as double), 5) as similarity from assigned",
        assign("centroids"),
    ),
    "kmeans_update": with_views(
        ["ratings", "centroids"],
        "select k, round(cast(similarity as double), 5) as similarity, movie_id, total, start, reviews, members from model",
        {**assign("centroids"), **{k if k != "centroids" else "next_centroids": v for k, v in update().items()}},
    ),
    "kmeans_iterate": with_views(
        ["ratings"],
        f"select k, round(cast(similarity as double), 5) as similarity, movie_id, total, start, reviews, settled from {LAST_MODEL}, settled",
        PASSES,
    ),
    "kmeans_members": with_views(
        ["ratings", "centroids"],
        "select cluster, concat(movie_id, ':', rater_id, '_', rating) as line from ratings join assigned using (movie_id)",
        assign("centroids"),
    ),
    "classify_by_file": with_views(
        ["ratings"], "select movie_id, cluster from assigned", {**FIRST_MODEL, **assign("centroids_start")}
    ),
    "kv_text_sink": with_views(["ratings"], "select rating, count(*) as n from ratings group by rating"),
    "job_result_sink": """
        select o_totalprice as exec_time, o_orderkey % 313 + 0.5::double as latency, -0.25::double as utility,
               100.0::double as map_tasks, 20.0::double as red_tasks, cast(200 + o_orderkey % 997 as double) as deadline,
               o_orderkey % 10007 + 0.25::double as join_time, 3.0::double as priority, 1.0::double as deadline_type, 'WordCount' as job_class
        from orders where o_orderstatus <> 'P'""",
    "self_join": with_views(
        ["itemsets"],
        "select a.prefix, a.item as item_a, b.item as item_b from d a join d b on a.prefix = b.prefix and a.item < b.item",
        {"d": "select distinct prefix, item from itemsets"},
    ),
    "adj_list": with_views(
        ["edges"],
        """
        select node, side, block, string_agg(other, ',' order by other) as neighbours from ends group by node, side, block""",
        {
            "sides": "select distinct dst as node, 'from' as side, src as other from edges union all select distinct src, 'to', dst from edges",
            "counted": f"select *, {blocks_over('node, side')} as blocks from sides",
            "ends": f"select *, {block_of('other')} as block from counted",
        },
    ),
    "row_range": "select row_number() over () - 1 as row_id from orders",
    "teragen": tera("select key, value from rows"),
    "terasort": tera("select key, value, row_number() over (order by key, value) as place from rows"),
    "sort_pipeline": "select count(*) as rows, cast(0 as bigint) as errors from orders",
    "range_split_points": tera("select split, key from splits", SPLITS),
    "range_partition": tera(
        "select key, cast((select count(*) from splits s where s.key < r.key) as int) as part from rows r", SPLITS
    ),
    "teravalidate": with_views(
        ["sorted_rows"],
        """
        select concat('misorder in ', file, ' last: ''', last, ''' current: ''', key, '''') as error from near where key < last
        union all
        select concat('misordered keys last: ', last_name, ' ''', last, ''' current: ', end_name, ' ''', key, '''') from chain where key < last""",
        {
            "near": "select *, lag(key) over (partition by file order by pos) as last from sorted_rows",
            "ends": """
                select concat(file, ':begin') as end_name, arg_min(key, pos) as key from sorted_rows group by file
                union all select concat(file, ':end'), arg_max(key, pos) from sorted_rows group by file""",
            "chain": "select *, lag(end_name) over (order by end_name) as last_name, lag(key) over (order by end_name) as last from ends",
        },
    ),
    "utility": with_views(["job_snapshots"], f"select snapshot_id, job_id, round({utility('join_time')}, 6) as utility from job_snapshots"),
    "utility_readable": with_views(
        ["job_snapshots"], f"select snapshot_id, job_id, round({readable('join_time')}, 6) as utility_readable from job_snapshots"
    ),
    "invert_utility": with_views(
        ["job_snapshots"],
        f"select snapshot_id, job_id, round({inverted_time('priority * (rem_map - 99.5) / 90')}, 6) as time from job_snapshots",
    ),
    "exec_time": with_views(
        ["job_runs"],
        f"""
        select job_id, cast(case when finish_ms is null then 0
               else {round2('(finish_ms - launch_ms) / 1000.0::double')} end as double) as exec_time from job_runs""",
    ),
    "latency": with_views(
        ["job_runs"],
        f"""
        select job_id, cast(case when finish_ms is null then 0
               else {round2('(finish_ms - launch_ms) / 1000.0::double - deadline')} end as double) as latency from job_runs""",
    ),
    "task_time_estimate": with_views(
        ["task_events", "planned_jobs"],
        f"""
        select job_id, is_map, tasks, {ESTIMATE} as estimate from (
            select job_id, is_map, coalesce(tasks, 0) as tasks,
                   cast(trunc(coalesce(run_time, 0) + prior) as bigint) // (coalesce(tasks, 0) + 1) as m
            from wanted left join totals using (job_id, is_map))""",
        {
            "totals": """
            select job_id, is_map, sum(cast(run_time as decimal(18, 6))) filter (succeeded) as run_time, count(*) filter (succeeded) as tasks
            from task_events group by 1, 2""",
            "wanted": """
            select job_id, true as is_map, map_prior as prior from planned_jobs
            union all select job_id, false, red_prior from planned_jobs""",
        },
    ),
    "remaining_demand": with_views(
        ["job_snapshots"], f"select snapshot_id, job_id, cast({DEMAND} as bigint) as demand, {DELAY} as delay from job_snapshots"
    ),
    "horizon_slots": with_views(
        ["job_snapshots"],
        """
        select snapshot_id, cast(ceil(sum(rem_map * floor(est_map / 10)) / 40.0 + sum(rem_red * floor(est_red / 10)) / 40.0) as bigint) as slots
        from job_snapshots group by 1""",
    ),
    "backlog_edf": with_views(["job_snapshots"], SUMMARY, backlog("deadline")),
    "backlog_fifo": with_views(["job_snapshots"], SUMMARY, backlog("join_time")),
    "risk_reward_rank": with_views(
        ["job_snapshots"], "select snapshot_id, job_id, remaining, round(reward, 6) as reward from rewarded", REWARDS
    ),
    "backlog_rrh": with_views(
        ["job_snapshots"], SUMMARY, {**REWARDS, **backlog(f"round(reward, {jobs.REWARD_PLACES})", "rewarded")}
    ),
    "utility_summary": with_views(
        ["job_snapshots"],
        SUMMARY,
        {"scored": f"select snapshot_id, {utility('rem_map * 10.0')} as u, {readable('rem_map * 10.0')} as r from job_snapshots"},
    ),
    "priority_share": with_views(
        ["job_snapshots"],
        """
        select snapshot_id, job_id, 5 + cast(trunc((100.0 - 5 * count(*) over w) * priority / sum(priority) over w) as bigint) as share
        from job_snapshots window w as (partition by snapshot_id)""",
    ),
    "equal_share": with_views(
        ["job_snapshots"],
        """
        select snapshot_id, job_id, (cents - case when cents * n > 10000 and cents > 0 then 1 else 0 end) / 100.0::double as share
        from (select *, cast(round_even(round_even(100.0::double / n, 2) * 100, 0) as bigint) as cents
              from (select *, count(*) over (partition by snapshot_id) as n from job_snapshots))""",
    ),
    "earliest_deadline": with_views(
        ["job_snapshots"],
        """
        select snapshot_id, job_id, deadline + join_time as due from job_snapshots
        qualify row_number() over (partition by snapshot_id order by deadline + join_time, job_id) = 1""",
    ),
    "feasibility": with_views(
        ["job_snapshots"],
        """
        select snapshot_id, count(*) filter (due * 100 > trunc(deadline / 180.0) * 40) as infeasible
        from (select *, count(*) over (partition by snapshot_id order by deadline) as due from job_snapshots) group by 1""",
    ),
    "concurrency_timeline": with_views(
        ["job_snapshots"],
        """
        select tick, cast(sum(change) over (order by tick) as bigint) as online
        from (select t.tick, coalesce(change, 0) as change from ticks t left join per_tick p on t.tick = p.tick)""",
        {
            "moments": """
            select cast(floor(join_time) as bigint) + 1 as tick, 1 as change from job_snapshots
            union all select cast(floor(join_time + deadline) as bigint) + 1, -1 from job_snapshots""",
            "per_tick": "select tick, sum(change) as change from moments group by 1",
            "ticks": "select unnest(range(1, (select max(tick) from moments) + 1)) as tick",
        },
    ),
    "result_log_files": """
        select case o_custkey % 3 when 0 then 'EDF' when 1 then 'RRH-2' else 'a b' end as policy, cast(o_orderkey % 2 as int) as iteration,
               count(*) as jobs, sum(floor(o_totalprice / 1000) + 0.5) as exec_time
        from orders where o_orderstatus <> 'P' group by 1, 2""",
    "result_log_timeline": with_views(
        [],
        """
        select policy, iteration, tick, cast(sum(change) over (partition by policy, iteration order by tick) as bigint) as online
        from (select t.*, coalesce(change, 0) as change from ticks t left join per_tick p using (policy, iteration, tick))""",
        {
            "done": """
            select case o_custkey % 3 when 0 then 'EDF' when 1 then 'RRH-2' else 'a b' end as policy, cast(o_orderkey % 2 as int) as iteration,
                   o_orderkey % 10007 + 0.25::double as begins, floor(o_totalprice / 1000) + 0.5::double as lasts
            from orders where o_orderstatus <> 'P'""",
            "moments": """
            select policy, iteration, cast(floor(begins) as bigint) + 1 as tick, 1 as change from done
            union all select policy, iteration, cast(floor(begins + lasts) as bigint) + 1, -1 from done""",
            "per_tick": "select policy, iteration, tick, sum(change) as change from moments group by all",
            "ticks": "select policy, iteration, unnest(range(1, last + 1)) as tick from (select policy, iteration, max(tick) as last from moments group by all)",
        },
    ),
    "gen_job_profiles": f"""
        with draws as (
            select o_orderkey as job_id, row_number() over (order by o_orderkey) as place from orders),
        gaps as (
            select *, case when place <= 2 then 0
                           else cast(round_even(-{traces.MEAN_GAP} * ln(1 - {uniform('gap')}) * 100, 0) as bigint) end as cents from draws),
        shaped as (
            select *, 0 as utility_type, -1000.0::double as beta,
                   case when {uniform('type')} < 0.2 then 0 when {uniform('type')} < 0.2 + 0.6::double then 1 else 2 end as deadline_type,
                   {_class_case([100 / 40 * traces.TASK_SECONDS[c][0] + 20 / 40 * traces.TASK_SECONDS[c][1] for c in traces.TRACE_CLASSES])} as run_time
            from gaps)
        select job_id, cast(100 as int) as map_tasks, cast(20 as int) as red_tasks, cast(ceil((1 + {uniform('deadline')}) * run_time) as double) as deadline,
               5.0::double + sum(cents) over (order by job_id) / 100.0::double as join_time,
               cast(floor({uniform('priority')} * 5 + 1) as double) as priority, cast(deadline_type as int) as deadline_type,
               cast(utility_type as int) as utility_type, round({SENSITIVITY}, 6) as sensitivity,
               {_class_case(list(traces.TRACE_CLASSES))} as job_class, concat('job', cast(job_id as varchar)) as job_name
        from shaped""",
    "repair_sensitivity": with_views(
        ["job_snapshots"],
        f"select snapshot_id, job_id, round({SENSITIVITY}, 6) as sensitivity from (select *, sensitivity - 0.5 as beta from job_snapshots)",
    ),
    "update_bursts": with_views(["task_events"], EVENT_BURSTS.format(keys="", gap="30 seconds", part="")),
    "stream_update_bursts": with_views(
        ["task_events"],
        EVENT_BURSTS.format(keys="job_id,", gap="1 hour", part="partition by job_id"),
    ),
    "stream_task_estimate": with_views(
        ["task_events", "planned_jobs"],
        f"""
        select job_id, is_map, tasks, {ESTIMATE} as estimate from (
            select job_id, is_map, tasks, cast(trunc(run_time + case when is_map then map_prior else red_prior end) as bigint) // (tasks + 1) as m
            from planned_jobs join (select job_id, is_map, coalesce(sum(cast(run_time as decimal(18, 6))) filter (succeeded), 0) as run_time,
                         count(*) filter (succeeded) as tasks
                  from task_events group by 1, 2) using (job_id))""",
    ),
}
