"""Independent DuckDB SQL for the queries, by name."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_EV = "ev as (select user_id as source_id, event_id, event_type, value, props, (epoch_us(ts) - 1704067200000000) / 3.6e9 as t from events)"
_NUM = _EV + ", num as (select *, row_number() over (partition by source_id order by t, event_id) - 1 as idx from ev)"
_WORDS = r"""
turns as (select conv_id as source_id, turn, role, regexp_extract_all(text, '\S+') as w from conversations),
placed as (select *, coalesce(sum(len(w)) over (partition by source_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from turns),
words as (select source_id, turn, role, (before + k - 1)::bigint as word_idx, w[k] as word, (before + k - 1) * 0.4::double as start_s, (before + k) * 0.4::double as end_s
          from (select *, unnest(range(1, len(w) + 1)) as k from placed))"""
_GROUPS = _WORDS + """,
groups as (select source_id, (word_idx // 4)::bigint as g, arg_min(start_s, word_idx) as start_s, arg_max(end_s, word_idx) as end_s, count(*) as n_words, replace(upper(string_agg(word, ' ' order by word_idx)), 'ẞ', 'SS') as shown from words group by all)"""
_FRAMES = """,
ends as (select source_id, max(end_s) + 1.0::double as e from words group by 1),
frames as (select source_id, frame_idx, frame_idx / 5.0::double as t from (select source_id, unnest(range(0, ceil(e * 5)::bigint)) as frame_idx from ends))"""
_GAPS = _EV + """,
gaps as (select * from (select source_id, lag(t) over (partition by source_id order by t, event_id) as s, t as e from ev) where e - s > 24.0),
src as (select distinct source_id, 720.0::double as total from ev)"""
_KEEPS = _GAPS + """,
cand as (
  select source_id, coalesce(lag(e) over (partition by source_id order by s) - 0.075::double, 0.0) as s, s + 0.075::double as e from gaps
  union all
  select src.source_id, coalesce(max(gaps.e) - 0.075::double, 0.0), any_value(total) from src left join gaps using (source_id) group by src.source_id),
pos as (select * from cand where e > s),
isl as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by source_id order by s, e rows unbounded preceding) as g
        from (select *, max(e) over (partition by source_id order by s, e rows between unbounded preceding and 1 preceding) as reach from pos)),
keeps as (select source_id, row_number() over (partition by source_id order by min(s)) - 1 as seg_idx, min(s) as start_s, max(e) as end_s from isl group by source_id, g)"""
_FACES = _NUM + """,
face as (select source_id, idx // 5 as g, idx, value / 500 * 1920 as cx, 100 + 300 * (value / 500) as w, 100 + 200 * (1 - value / 500) as h, (event_id % 10) / 10.0::double as score from num)"""
_DEDUP = """,
ordered as (select source_id, hit_id, start_s, score, row_number() over (partition by source_id order by start_s, hit_id, score) as rn from hits),
fold as (
  select source_id, rn, start_s as ks, hit_id as ki, score as kv, null::bigint as done from ordered where rn = 1
  union all
  select o.source_id, o.rn,
         case when o.start_s - f.ks >= 30 or o.score > f.kv then o.start_s else f.ks end,
         case when o.start_s - f.ks >= 30 or o.score > f.kv then o.hit_id else f.ki end,
         case when o.start_s - f.ks >= 30 or o.score > f.kv then o.score else f.kv end,
         case when o.start_s - f.ks >= 30 then f.ki end
  from fold f join ordered o on o.source_id = f.source_id and o.rn = f.rn + 1),
kept_ids as (select source_id, done as hit_id from fold where done is not null
             union all select source_id, arg_max(ki, rn) from fold group by source_id),
kept as (select h.* from hits h join kept_ids k using (source_id, hit_id))"""


def _with(body: str, query: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{body}\n{query}"


_METRICS = """
select {key}, sum(n)::bigint as word_count, sqrt(sum(sq) / sum(n)) as rms, max(pk) as peak,
       case when count(*) > 1 then var_pop(sqrt(sq / n)) else 0.0 end as energy_var, sum(n) / {dur}::double as rate, sum(q) / sum(n) as silence_ratio
from (select {key}, sub, count(*) as n, sum(value * value) as sq, max(abs(value)) as pk, count(*) filter (abs(value) < case when peak > 0 then 0.05::double * peak else 0.01 end) as q
      from (select *, max(abs(value)) over (partition by {key}) as peak from {rows}) group by {key}, sub) group by {key}"""

ORACLES["passage_topk"] = _with(
    _EV + ", grid as (select unnest(range(0, 40)) as passage_idx), inw as (select passage_idx, value, floor(t - passage_idx * 20.0) as sub from ev join grid on t >= passage_idx * 20.0 and t < passage_idx * 20.0 + 30),"
    + " m as (" + _METRICS.format(key="passage_idx", dur=30, rows="inw") + "),"
    + """ b as (select *, min(rms) over () as l1, max(rms) over () as h1, min(energy_var) over () as l2, max(energy_var) over () as h2, min(rate) over () as l3, max(rate) over () as h3 from m),
    s as (select *, round((0.25::double * case when h1 = l1 then 0.5 else (rms - l1) / (h1 - l1) end + 0.35::double * case when h2 = l2 then 0.5 else (energy_var - l2) / (h2 - l2) end
      + 0.25::double * case when h3 = l3 then 0.5 else (rate - l3) / (h3 - l3) end
      + 0.15::double * case when silence_ratio < 0.15 then 0.7 when silence_ratio < 0.35 then 1.0 else greatest(0.0, 1 - (silence_ratio - 0.35::double) / 0.3::double) end) * 10, 5) as score from b)""",
    """select passage_idx, passage_idx * 20.0::double as start_s, passage_idx * 20.0::double + 30 as end_s, word_count, round(rms, 6) as rms, round(energy_var, 6) as energy_var, round(rate, 6) as rate,
       round(silence_ratio, 6) as silence_ratio, score, row_number() over (order by score desc, passage_idx) as rank,
       printf('%02d:%02d:%02d', passage_idx * 20 // 3600, passage_idx * 20 % 3600 // 60, passage_idx * 20 % 60) as clock, printf('%d:%02d', passage_idx * 20 // 60, passage_idx * 20 % 60) as label
       from s order by score desc, passage_idx limit 20""",
)
ORACLES["energy_variance"] = _with(
    _NUM + ", runs as (select source_id, idx // 10 as run, sqrt(avg(value * value)) as e from num group by all having count(*) = 10), v as (select source_id, case when count(*) > 1 then var_pop(e) else 0 end as v from runs group by 1)",
    "select distinct ev.source_id, round(coalesce(v, 0.0), 4) as energy_var from ev left join v using (source_id)",
)
ORACLES["audio_metrics"] = _with(
    _EV + ", r as (select *, floor(t / 30) as sub from ev), m as (" + _METRICS.format(key="source_id", dur=720, rows="r") + ")",
    "select source_id, word_count, round(rms, 6) as rms, round(peak, 6) as peak, round(rate, 6) as rate, round(silence_ratio, 6) as silence_ratio, round(energy_var, 4) as energy_var from m",
)
ORACLES["metric_defaults"] = _with(
    _EV + ", r as (select *, floor(t) as sub, floor(t / 20)::bigint as passage_idx from ev), m as (" + _METRICS.format(key="source_id, passage_idx", dur=20, rows="r") + ")",
    """select s.source_id, s.passage_idx, round(coalesce(rms, 0.1), 6) as rms, round(coalesce(peak, 0.2), 6) as peak, round(coalesce(energy_var, 0.01), 6) as energy_var, round(coalesce(rate, 3.0), 6) as rate,
       round(coalesce(silence_ratio, 0.2), 6) as silence_ratio from (select distinct source_id, unnest(range(0, 36)) as passage_idx from ev) s left join m using (source_id, passage_idx)""",
)
ORACLES["minmax_norm"] = _with(
    _EV + ", m as (select event_type, source_id, avg(value) as m from ev group by all), b as (select *, min(m) over (partition by event_type) as lo, max(m) over (partition by event_type) as hi from m)",
    "select event_type, source_id, round(case when hi = lo then 0.5 else (m - lo) / (hi - lo) end, 6) as norm from b",
)
ORACLES["transcript_words"] = _with(
    _WORDS,
    "select source_id, turn, word_idx, word, round(start_s, 6) as start_s, round(coalesce(lead(start_s) over (partition by source_id, turn order by word_idx), max(end_s) over (partition by source_id, turn)), 6) as end_s from words",
)
ORACLES["word_counts"] = r"""
select conv_id, turn, len(regexp_extract_all(text, '\S+')) as words, right(rtrim(text), 1) in ('.', '!', '?', '…') as final,
       case when length(text) > 100 then left(text, 100) || '...' else text end as hook, replace(upper(left(text, 20)), 'ẞ', 'SS') as shown
from conversations"""
ORACLES["sentence_windows"] = _with(
    r"""raw as (select conv_id as source_id, turn, regexp_extract_all(text, '[^.!?…]+[.!?…]*') as p from conversations),
    pieces as (select * from (select source_id, turn, k, trim(p[k]) as text from (select *, unnest(range(1, len(p) + 1)) as k from raw)) where text <> ''),
    counted as (select *, len(regexp_extract_all(text, '\S+')) as n from pieces),
    cues as (select source_id, row_number() over w - 1 as cue_idx, (sum(n) over w - n) * 0.4::double as s, (sum(n) over w) * 0.4::double as e, text
             from counted window w as (partition by source_id order by turn, k rows unbounded preceding)),
    ends as (select source_id, max(e) as m from cues group by 1),
    grid as (select source_id, k, k * 20.0::double as st from (select source_id, unnest(range(0, ceil(m / 20)::bigint)) as k from ends)),
    snapped as (select g.*, (select arg_min(c.e, (abs(c.e - (g.st + 30)), c.cue_idx)) from cues c
                          where c.source_id = g.source_id and c.s < g.st + 45 and c.e > g.st and c.e >= g.st + 20 and right(rtrim(c.text), 1) in ('.', '!', '?', '…')) as snap
             from grid g where exists (select 1 from cues c where c.source_id = g.source_id and c.s < g.st + 45 and c.e > g.st)),
    win as (select source_id, k, st, coalesce(snap, st + 30) as en from snapped),
    txt as (select w.source_id, w.k, w.st, w.en, string_agg(c.text, ' ' order by c.cue_idx) as text from win w join cues c on c.source_id = w.source_id and c.s < w.en and c.e > w.st group by all)""",
    r"select source_id, k as passage_idx, round(st, 6) as start_s, round(en, 6) as end_s, text, len(regexp_extract_all(text, '\S+')) as word_count from txt",
)
ORACLES["karaoke_groups"] = _with(_GROUPS, "select source_id, g as group_idx, round(start_s, 6) as start_s, round(end_s, 6) as end_s, n_words, shown from groups")
_ACTIVE = _GROUPS + _FRAMES + """,
shown as (select f.source_id, f.frame_idx, f.t, min(g.g) as g from frames f left join groups g on g.source_id = f.source_id and g.start_s <= f.t and f.t <= g.end_s + 0.3::double group by all),
act as (select s.source_id, s.frame_idx, s.g as group_idx,
        case when s.g is not null then coalesce(min(w.word_idx - 4 * s.g) filter (w.start_s <= s.t and s.t <= w.end_s + 0.15::double), max(w.word_idx - 4 * s.g) filter (w.start_s <= s.t), -1) end as word
        from shown s left join words w on w.source_id = s.source_id and w.word_idx // 4 = s.g group by s.source_id, s.frame_idx, s.g)"""
ORACLES["active_word"] = _with(_ACTIVE, "select * from act")
ORACLES["render_cache"] = _with(_ACTIVE, "select source_id, count(distinct (group_idx, word)) as pictures from act where group_idx is not null group by 1")
ORACLES["asof_group"] = _with(
    _GROUPS + _FRAMES,
    """select f.source_id, f.frame_idx, min(g.g) as group_idx, coalesce(arg_min(g.start_s, g.g) <= f.t, false) as active
       from frames f left join groups g on g.source_id = f.source_id and g.end_s > f.t group by f.source_id, f.frame_idx, f.t""",
)
ORACLES["lit_words"] = _with(
    _WORDS + _FRAMES,
    "select f.source_id, f.frame_idx, count(*) as lit, min(word_idx) as first_word from frames f join words w on w.source_id = f.source_id and w.start_s <= f.t and f.t < w.start_s + 1.0 group by all",
)
ORACLES["speaker_at"] = _with(
    _WORDS + _FRAMES + """, seg as (select source_id, turn, role, min(start_s) as s, max(end_s) as e from words group by all),
    mid as (select role, median(e - s) as middle from seg group by 1),
    hit as (select f.source_id, f.frame_idx, arg_min(role, turn) as speaker from frames f left join seg on seg.source_id = f.source_id and s <= f.t and f.t <= e group by all)""",
    "select source_id, frame_idx, speaker, round(middle, 6) as middle from hit left join mid on role = speaker",
)
ORACLES["crop_cover"] = _with(
    _NUM + """, seg as (select source_id, idx, floor(value)::bigint as crop_x, trunc(t)::bigint as lo, trunc(least(t + 6, 720.0::double))::bigint as hi from num),
    grid as (select source_id, unnest(range(0, 720)) as frame_idx from (select distinct source_id from ev))""",
    "select g.source_id, frame_idx, coalesce(arg_max(crop_x, idx), 0) as crop_x from grid g left join seg on seg.source_id = g.source_id and lo <= frame_idx and frame_idx < hi group by all",
)
ORACLES["hit_text"] = _with(
    _WORDS,
    """select h.source_id, h.turn as hit_id, string_agg(w.word, ' ' order by w.word_idx) as text
       from (select source_id, turn, min(start_s) as start_s from words group by all) h join words w
       on w.source_id = h.source_id and w.start_s >= h.start_s - 1 and w.start_s <= h.start_s + 6 group by h.source_id, h.turn""",
)
ORACLES["speaker_median"] = _with(_EV, "select event_type, round(median(value / 500), 6) as cx, count(*) as n from ev where event_id % 5 = 0 group by 1")
ORACLES["hot_quantiles"] = "select l_returnflag, round(quantile_cont(l_extendedprice::double, 0.5), 4) as median, round(quantile_cont(l_extendedprice::double, 0.95), 4) as p95, count(*) as n from lineitem group by 1"
_SOFAR = "over (partition by source_id order by t, event_id rows between unbounded preceding and current row)"
ORACLES["forward_fill"] = _with(_EV, f"select source_id, event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) {_SOFAR} as filled from ev")
ORACLES["hold"] = _with(_EV, f"select source_id, event_id, round(coalesce(last_value(case when event_id % 3 = 0 then value / 500 end ignore nulls) {_SOFAR}, 0.5), 6) as held from ev")
ORACLES["moving_avg"] = _with(_EV, "select source_id, event_id, round(avg(value) over (partition by source_id order by t, event_id rows between 15 preceding and 15 following), 6) as smooth from ev")
ORACLES["interp_linear"] = _with(
    _NUM + """, k as (select source_id, idx, value from num where event_id % 4 = 0),
    j as (select n.source_id, n.event_id, n.idx, (select max(idx) from k where k.source_id = n.source_id and k.idx <= n.idx) as li, (select min(idx) from k where k.source_id = n.source_id and k.idx >= n.idx) as ri from num n)""",
    """select j.source_id, event_id, round(case when li is null then r.value when ri is null or ri = li then l.value else l.value + (r.value - l.value) / (ri - li) * (j.idx - li) end, 6) as value
       from j left join k l on l.source_id = j.source_id and l.idx = li left join k r on r.source_id = j.source_id and r.idx = ri""",
)
ORACLES["argmax_face"] = _with(
    _FACES + ", best as (select source_id, g, arg_min(idx, (-(w * h * (0.5::double + 0.5::double * (1 - abs(cx - 960.0::double) / 960.0::double)) * score), idx)) as b from face group by all)",
    "select best.source_id, best.g as idx, b as face_idx, round(cx, 6) as cx from best join face on face.source_id = best.source_id and face.idx = b",
)
ORACLES["target_face"] = _with(
    _FACES + """, ok as (select * from face where score >= 0.3::double), groups as (select distinct source_id, g from face),
    a as (select source_id, g, count(*) as n, arg_min(cx, (abs(cx - 960), idx)) as near, arg_min(cx, (-w, idx)) as wide, min(cx) as one from ok group by all)""",
    "select s.source_id, s.g as idx, round(case when n = 1 then one when n > 1 and s.g % 2 = 0 then near when n > 1 then wide end, 6) as cx from groups s left join a using (source_id, g)",
)
ORACLES["start_position"] = _with(
    _FACES + ", ok as (select * from face where score >= 0.5 and g < 5), f as (select source_id, min(g) as g from ok group by 1), c as (select ok.source_id, arg_min(cx / 1920, (-w, idx)) as cx from ok join f using (source_id, g) group by 1)",
    "select s.source_id, round(least(greatest(coalesce(cx, 0.5), 0.0), 1.0), 6) as start_cx from (select distinct source_id from ev) s left join c using (source_id)",
)
_EMA = _NUM + """, ema as (select source_id, idx, value as e from num where idx = 0 union all
  select n.source_id, n.idx, 0.92::double * m.e + (1 - 0.92::double) * n.value from ema m join num n on n.source_id = m.source_id and n.idx = m.idx + 1)"""
ORACLES["ema_series"] = _with(_EMA, "select source_id, idx, round(e, 6) as ema from ema", True)
ORACLES["ema_final"] = _with(
    _NUM + ", l as (select source_id, list(value order by idx) as v from num group by 1)",
    "select source_id, round(list_reduce(v, lambda a, x: 0.92::double * a + (1 - 0.92::double) * x), 6) as ema from l",
)
_HITS = ", hits as (select source_id, event_id as hit_id, t as start_s, value as score from ev)"
ORACLES["near_dedup"] = _with(_EV + _HITS + _DEDUP, "select source_id, hit_id, round(start_s, 6) as start_s, score from kept", True)
ORACLES["merge_rank"] = _with(
    _EV + ", hits as (select source_id, event_id as hit_id, t as start_s, value as score, case event_type when 'click' then 'audio' else 'text' end as source from ev where event_type in ('click', 'purchase'))" + _DEDUP,
    "select source_id, hit_id, source, score, rank from (select *, row_number() over (partition by source_id order by score desc, start_s, hit_id) as rank from kept) where rank <= 5", True,
)
ORACLES["top_clips"] = _with(
    _EV, "select event_id as hit_id, source_id, value as score, row_number() over (order by value desc, t, event_id) as rank, printf('%d:%02d', floor(t)::bigint // 60, floor(t)::bigint % 60) as label from ev order by value desc, t, event_id limit 5",
)
ORACLES["silence_gaps"] = _with(_GAPS, "select source_id, round(s, 6) as start_s, round(e, 6) as end_s, round(e - s, 6) as duration_s from gaps")
ORACLES["keep_segments"] = _with(_KEEPS, "select source_id, seg_idx, round(start_s, 6) as start_s, round(end_s, 6) as end_s from keeps")
ORACLES["cut_durations"] = _with(_KEEPS, "select source_id, round(sum(end_s - start_s), 6) as kept, round(720.0::double - sum(end_s - start_s), 6) as removed from keeps group by 1")
ORACLES["cutter_segments"] = _with(
    _GAPS + """, h as (select source_id, coalesce(lag(e) over (partition by source_id order by s) - 0.075::double, 0.0) as a, s as c, s + 0.075::double as b from gaps),
    r as (select source_id, a, b from h where c > a union all select * from (select src.source_id, coalesce(max(gaps.e) - 0.075::double, 0.0) as a, any_value(total) as b from src left join gaps using (source_id) group by 1) where a < b)""",
    "select source_id, row_number() over (partition by source_id order by a, b) - 1 as seg_idx, round(a, 6) as start_s, round(b, 6) as end_s from r",
)
ORACLES["time_remap"] = _with(
    _KEEPS + ", k as (select *, coalesce(sum(end_s - start_s) over (partition by source_id order by seg_idx rows between unbounded preceding and 1 preceding), 0.0) as base from keeps)",
    "select ev.source_id, event_id, round(base + t - start_s, 6) as t_cut from ev left join k on k.source_id = ev.source_id and start_s <= t and t < end_s",
)
ORACLES["interval_merge"] = _with(
    _EV + """, r as (select source_id, t as s, t + 6 as e, max(t + 6) over (partition by source_id order by t, event_id rows between unbounded preceding and 1 preceding) as reach from ev),
    i as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by source_id order by s rows unbounded preceding) as g from r)""",
    "select source_id, row_number() over (partition by source_id order by min(s)) - 1 as seg_idx, round(min(s), 6) as start_s, round(max(e), 6) as end_s from i group by source_id, g",
)
ORACLES["passage_overlap"] = _with(
    _NUM, "select a.source_id, a.idx as w, count(*) as n, min(b.idx) as first_idx from num a join num b on a.source_id = b.source_id and b.t < a.t + 40 and b.t + 3 > a.t group by all",
)
ORACLES["motion_stats"] = _with(
    _EV + ", d as (select source_id, abs(value - lag(value) over (partition by source_id order by t, event_id)) as d from ev)", "select source_id, round(max(d), 6) as max_step, round(avg(d), 6) as mean_step from d group by 1",
)
ORACLES["shot_counts"] = _with(
    _EV, "select source_id, count(*) filter (value / 500 >= 0.5) as wide, count(*) filter (value / 500 < 0.5 and value / 500 >= 0.1::double) as close, count(*) filter (value / 500 < 0.1::double) as none, round(count(*) filter (value / 500 >= 0.1::double) / count(*), 6) as coverage from ev group by 1",
)
ORACLES["segment_stats"] = _with(
    _EV + ", a as (select source_id, floor(t / 24)::bigint as seg_idx, median(value) as crop_x, avg(case when event_id % 4 <> 0 then value end) as cx, avg(case when event_id % 4 <> 0 then value / 5 end) as w from ev group by all), b as (select *, abs(cx - (crop_x + 100)) / 200.0::double as o from a)",
    "select source_id, seg_idx, round(crop_x, 9) as crop_x, round(cx, 9) as avg_face_cx, round(o, 9) as offset_share, round(w / 200.0::double, 9) as face_share, case when cx is null then 'N/A' when o <= 0.1::double then 'OK' else 'WARN' end as verdict from b",
)
ORACLES["crop_geometry"] = _with(
    _EV + """, g as (select event_id, value / 500 as cx, case when event_id % 2 = 0 then 1920 else 480 end as w from ev),
    c as (select *, case when 607 > w then w else 607 end as crop_w, case when 607 > w then trunc(w * 16 / 9)::bigint else 1080 end as crop_h from g),
    x as (select *, greatest(0, least(trunc(cx * w - crop_w / 2)::bigint, w - crop_w)) as crop_x from c),
    m as (select *, crop_w * (1 - 0.6::double) / 2 as margin, cx * w * 0.9::double as face from x),
    n as (select *, case when face < crop_x + margin then face - margin when face > crop_x + crop_w - margin then face + margin - crop_w else crop_x end as moved from m)""",
    """select event_id, crop_w, crop_h, crop_x, greatest(0, least(trunc(moved)::bigint, w - crop_w)) as safe_x,
       case when w / 1080 > 0.5625::double then (w - trunc(1080 * 1080 / 1920)::bigint) // 2 else 0 end as box_x, case when w / 1080 > 0.5625::double then trunc(1080 * 1080 / 1920)::bigint else w end as box_w from n""",
)
ORACLES["silence_scores"] = _with(
    _EV + ", r as (select event_id, value, value / 500 as q from ev)",
    """select event_id, round(case when q < 0.15::double then 0.7 when q < 0.35::double then 1.0 else greatest(0.0, 1 - (q - 0.35::double) / 0.3::double) end, 6) as silence,
       round(case when event_id % 3 > 0 then (event_id % 7) / (event_id % 3) else 0 end, 6) as rate,
       case when value * 3 > 0.88::double * 1080 then trunc(60 * 0.85::double * 1080 / (value * 3))::bigint else 60 end as font from r""",
)
ORACLES["clock_texts"] = _with(
    _EV + ", s as (select event_id, event_type, floor(t * 60)::bigint as s from ev), c as (select *, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) as clock, printf('%d:%02d', s // 60, s % 60) as label from s)",
    """select event_id, clock, label, s::double as back, round(s + (event_id % 1000) / 1000.0::double, 6) as lenient, round(s + (event_id % 1000) / 1000.0::double, 6) as strict,
       (s % 3600)::double as short, '[' || s || 's / ' || label || '] ' || event_type as line from c""",
)
ORACLES["tag_strip"] = r"select page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from pages"
ORACLES["clean_words"] = r"""
with w as (select page_id, '&nbsp;<b>' || html || '</b> &amp;' as x from pages),
u as (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&amp;', '&') as x from w)
select page_id, regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '\[?[\s\x{A0}]*__[\s\x{A0}]*\]?', '***', 'g') as word from u"""
ORACLES["json_fallback"] = _with(
    _EV, "select event_id, case when event_id % 7 = 0 then -1 else coalesce((props->>'$.k')::bigint, -1) end as k, case when event_id % 7 = 0 then 'oops' else props end as inner from ev",
)
ORACLES["highlight_norm"] = _with(
    _EV + ", h as (select *, event_id % 2 = 0 as c, case when event_id % 2 = 0 then floor(t) else t end as s, case when event_id % 2 = 0 then floor(t + 31) else t + 31.9::double end as e from ev)",
    """select event_id, round(s, 6) as start_s, round(e, 6) as end_s, trunc(e - s)::bigint as duration, case when event_id % 3 = 0 then event_type else '' end as hook_text, '' as punchline, 'w' as why_viral,
       case when event_id % 5 <> 0 then floor(value)::bigint else 0 end as source_score, 'text' as source from h""",
)
ORACLES["score_lookup"] = """
select d.doc_id, case when length(text) > 50 then coalesce(quality, 0) else 0 end::bigint as score,
       case when length(text) <= 50 or text is null then 'text_too_short' when quality is null then 'parse_error' else 'scored' end as verdict
from documents d left join labels l using (doc_id)"""
_BATCH = "b as (select doc_id, (row_number() over (order by doc_id) - 1) // 25 as batch, (row_number() over (order by doc_id) - 1) % 25 + 1 as id from documents)"
ORACLES["batch_ids"] = _with(_BATCH, "select * from b")
ORACLES["batch_scores"] = _with(
    _BATCH + ", a as (select batch, id - 1 as id, doc_id % 11 as score from b)",
    "select b.batch, count(*) as scored, count(*) filter (score >= 7) as passed from b join a using (batch, id) where a.id >= 1 group by 1",
)
ORACLES["sampled_cues"] = "select event_id, event_type from events where event_id % 5 = 0 order by event_id limit 500"
ORACLES["line_layout"] = _with(
    _WORDS + """, p as (select source_id, word_idx, word_idx // 6 as g, word_idx % 6 // 3 as l, length(word) * 20.0::double as w from words),
    q as (select *, sum(w) over k as total, count(*) over k as n, coalesce(sum(w + 15) over (partition by source_id, g, l order by word_idx rows between unbounded preceding and 1 preceding), 0) as before,
          max(l) over (partition by source_id, g) + 1 as lines from p window k as (partition by source_id, g, l))""",
    "select source_id, word_idx, round((1080 - (total + 15 * (n - 1))) / 2 + before, 6) as x, round(0.7::double * 1920 - lines * 70.0::double / 2 + l * 70.0::double, 6) as y from q",
)
ORACLES["clip_words"] = _with(_WORDS, "select source_id, word_idx, round(greatest(start_s - 5, 0.0), 6) as start_s, round(least(end_s - 5, 20.0), 6) as end_s from words where start_s - 5 < 20 and end_s - 5 > 0")
ORACLES["merge_short"] = _with(
    _NUM + """, f as (select *, case when idx = 0 or floor(value / 150) <> lag(floor(value / 150)) over (partition by source_id order by idx) then 1 else 0 end as fresh from num),
    r as (select *, sum(fresh) over (partition by source_id order by idx rows unbounded preceding) as run from f),
    s as (select source_id, run, min(idx) as a, max(idx) + 1 as b, arg_min(floor(value)::bigint, idx) as x from r group by all),
    m as (select *, sum(case when run = 1 or b - a >= 2 then 1 else 0 end) over (partition by source_id order by run rows unbounded preceding) as g from s)""",
    "select source_id, (g - 1)::bigint as seg_idx, min(a) as start_idx, max(b) as end_idx, arg_min(x, run) as crop_x from m group by source_id, g",
)

# --- state machines, as recursions over the samples of a source ---------------------------

_SAMPLES = _FACES + """,
sample as (select source_id, g, list({'cx': cx, 'w': w, 'h': h, 'score': score} order by cx, idx) filter (score >= 0.6) as faces from face group by all)"""

ORACLES["hysteresis"] = _with(
    _SAMPLES + """,
    seen as (select *, coalesce(len(faces), 0) as n, faces[-1].cx / 1920 - faces[1].cx / 1920 > 0.3::double as wide from sample),
    chosen as (select source_id, g, n, n = 1 or n > 1 and not wide as restart,
                      case when n = 1 then faces[1].cx / 1920 when n > 1 then list_sort(list_transform(faces, lambda f, i: {'v': case when wide then -f.w else -f.score end, 'i': i, 'cx': f.cx}))[1].cx / 1920 end as x from seen),
    run as (
      select source_id, -1::bigint as g, 0.5::double as target, null::double as cand, 0 as cnt, []::double[] as buf from (select distinct source_id from ev)
      union all
      select source_id, g, case when not big then d when switch then c1 else target end, case when big and not switch then c1 end, case when big and not switch then n1 else 0 end,
             case when x is null then buf else list_append(buf, x)[-30:] end
      from (select *, n1 >= 3 as switch from (
        select *, case when agrees then c0 else d end as c1, case when agrees then n0 + 1 else 1 end as n1 from (
          select *, abs(d - target) > 0.15::double as big, c0 is not null and abs(d - c0) < 0.1::double as agrees from (
            select r.target, r.buf, c.source_id, c.g, c.x, case when c.restart then null else r.cand end as c0, case when c.restart then 0 else r.cnt end as n0,
                   greatest(607 / 3840::double, least(1 - 607 / 3840::double, coalesce(c.x, list_median(r.buf), r.target))) as d
            from run r join chosen c on c.source_id = r.source_id and c.g = r.g + 1)))))""",
    "select source_id, g as idx, round(target, 6) as target from run where g >= 0",
    recursive=True,
)
ORACLES["track_recover"] = _with(
    _SAMPLES + """,
    run as (
      select source_id, -1::bigint as g, ((1920 - 303) // 2)::bigint as crop_x, null::double as last, 0 as missed from (select distinct source_id from ev)
      union all
      select source_id, g, case when best.v >= 0.15 then greatest(0, least(trunc(best.cx - 303 / 2.0::double)::bigint, 1920 - 303)) else crop_x end,
             case when best.v >= 0.15 then best.cx else last end, case when best.v >= 0.15 then 0 else missed + 1 end
      from (
        select *, list_sort(list_transform(able, lambda f, i: {'v': (f.w * f.h / (1920 * 540) * 0.6::double + f.score * 0.4::double)
                 * case when last is null or lost then 1.0::double else 0.5::double + 0.5::double * greatest(0.0::double, 1 - abs(f.cx - last) / 500) end, 'i': -i, 'cx': f.cx}), 'DESC')[1] as best
        from (select *, case when len(list_filter(sized, lambda f: f.score >= 0.5)) > 0 then list_filter(sized, lambda f: f.score >= 0.5) else sized end as able
          from (select *, list_filter(faces, lambda f: f.w <= edge and f.h <= edge) as sized
            from (select r.crop_x, r.last, r.missed, r.missed > 1 as lost, 540 * case when r.missed > 1 then 0.7::double else 0.5::double end as edge, s.source_id, s.g, s.faces
                  from run r join sample s on s.source_id = r.source_id and s.g = r.g + 1)))))""",
    "select source_id, g as idx, crop_x from run where g >= 0",
    recursive=True,
)
ORACLES["segment_median"] = _with(
    _NUM + """,
    run as (
      select source_id, -1::bigint as idx, 0::bigint as first, 0::bigint as seg, []::double[] as xs, null::bigint as done_first, null::bigint as done_x from (select distinct source_id from ev)
      union all
      select source_id, idx, case when cut then idx else first end, case when cut then seg + 1 else seg end, case when cut then [value] else list_append(xs, value) end,
             case when cut then first end, case when cut then m end
      from (select *, len(xs) >= 3 and abs(value - m) > 0.15::double * 607 as cut
            from (select r.first, r.seg, r.xs, n.source_id, n.idx, n.value, trunc(list_median(r.xs))::bigint as m from run r join num n on n.source_id = r.source_id and n.idx = r.idx + 1))),
    ends as (select source_id, max(idx) as idx from run group by 1),
    segs as (select source_id, seg - 1 as seg_idx, done_first as start_idx, idx as end_idx, done_x as x from run where done_first is not null
             union all select r.source_id, seg, first, idx + 1, trunc(list_median(xs))::bigint from run r join ends using (source_id, idx) where len(xs) > 0)""",
    "select source_id, seg_idx, start_idx, end_idx, greatest(0, least(x, 393)) as crop_x from segs",
    recursive=True,
)
ORACLES["segment_median_chunked"] = ORACLES["segment_median"]
ORACLES["hysteresis_chunked"] = ORACLES["hysteresis"]
ORACLES["cut_quality"] = _with(
    _NUM + f""", s as (select * from ({ORACLES["segment_median"]})),
    m as (select *, sum(case when seg_idx = 0 or end_idx - start_idx >= 3 then 1 else 0 end) over (partition by source_id order by seg_idx) as g from s),
    merged as (select source_id, (g - 1)::bigint as seg_idx, min(start_idx) as start_idx, max(end_idx) as end_idx, arg_min(crop_x, seg_idx) as crop_x, arg_min(end_idx, seg_idx) as own_end from m group by source_id, g),
    q as (select g.*, avg(case when event_id % 4 <> 0 then value end) as cx, avg(case when event_id % 4 <> 0 then value / 5 end) as w
          from merged g join num n on n.source_id = g.source_id and n.idx >= g.start_idx and n.idx < g.own_end group by all)""",
    """select source_id, seg_idx, start_idx, end_idx, crop_x, round(cx, 6) as avg_face_cx, round(abs(cx - (crop_x + 303.5::double)) / 607, 6) as offset_share, round(w / 607, 6) as face_share,
       case when cx is null then 'N/A' when abs(cx - (crop_x + 303.5::double)) / 607 <= 0.1::double then 'OK' else 'WARN' end as verdict from q""",
)
ORACLES["greedy_groups"] = _with(
    _WORDS + """,
    need as (select source_id, word_idx, 20.0::double * length(replace(upper(word), 'ẞ', 'SS')) as w from words),
    run as (
      select source_id, -1::bigint as word_idx, 0::bigint as grp, 0::bigint as line, 0 as held, 0.0::double as used from (select distinct source_id from words)
      union all
      select source_id, word_idx, case when breaks and line = 1 then grp + 1 else grp end, case when breaks then (line + 1) % 2 else line end,
             case when breaks then 1 else held + 1 end, case when breaks then w else used + w + space end
      from (select *, held > 0 and (held = 3 or used + w + space > 400) as breaks from (
        select r.grp, r.line, r.held, r.used, n.source_id, n.word_idx, n.w, case when r.held > 0 then 10.0::double else 0 end as space
        from run r join need n on n.source_id = r.source_id and n.word_idx = r.word_idx + 1)))""",
    "select source_id, word_idx, grp as group_idx, line as line_idx from run where word_idx >= 0",
    recursive=True,
)

# --- readers, sinks, answers --------------------------------------------------------------

_TURNS = r"""
said as (select conv_id as source_id, row_number() over (partition by conv_id order by turn) - 1 as n, trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20<>]+', ' ', 'g')) as text from conversations),
cue as (select *, n * 100.0::double + 0.25 as s, n * 100.0::double + 0.25 + case when n % 2 = 1 then 0.01 else 90.0::double end as e from said)"""

ORACLES["vtt_all_cues"] = _with(_TURNS, "select source_id, n as cue_idx, round(s, 6) as start_s, round(e, 6) as end_s, text from cue where text <> ''")
ORACLES["vtt_separator_cues"] = _with(_TURNS, "select source_id, n as cue_idx, round(s, 6) as start_s, text from cue where n % 2 = 1 and text <> ''")
ORACLES["vtt_text_between"] = _with(_TURNS, "select source_id, string_agg(text, ' ' order by n) as text from cue where n % 2 = 1 and text <> '' and s between 100 and 351 group by 1")
ORACLES["vtt_word_cues"] = _with(
    _TURNS + """,
    w as (select source_id, n, s, e, string_split(text, ' ') as ws from cue where contains(text, ' ')),
    each as (select *, unnest(range(0, len(ws))) as k from w)""",
    """select source_id, n + 1 as cue_idx, k as word_idx, ws[k + 1] as word, round(s + k * 0.1::double, 6) as start_s,
       round(case when k + 1 < len(ws) then s + (k + 1) * 0.1::double else e end, 6) as end_s from each""",
)
ORACLES["words_json"] = _with(_WORDS, "select source_id, word_idx, word, round(start_s + 1.5, 6) as start_s, round(end_s + 1.5, 6) as end_s from words")
ORACLES["speakers_json"] = _with(
    _WORDS + ", t as (select source_id, turn, role, min(start_s) as s, max(end_s) as e from words group by all)",
    "select source_id, row_number() over (partition by source_id order by turn) - 1 as seg_idx, round(s, 6) as start_s, round(e, 6) as end_s, role as speaker from t",
)
ORACLES["crops_json"] = _with(_NUM, "select source_id, idx as seg_idx, round(t, 6) as start_s, round(t + 6, 6) as end_s, floor(value)::bigint as crop_x from num")
ORACLES["media_facts"] = _with(_EV + ", m as (select source_id, count(*) as n from ev group by 1)", "select source_id, 1920::bigint as width, n as total_frames, round(case when source_id % 3 = 0 then n * 2.5::double else n / 25.0::double end, 6) as duration_s from m")
ORACLES["silence_log"] = _with(_GAPS, "select source_id, row_number() over (partition by source_id order by s) - 1 as seg_idx, round(s, 6) as start_s, round(e, 6) as end_s, round(e - s, 6) as duration_s from gaps")
ORACLES["trim_graph"] = _with(
    _KEEPS,
    """select source_id, string_agg(printf('[0:v]trim=%.3f:%.3f,setpts=PTS-STARTPTS[v%d];[0:a]atrim=%.3f:%.3f,asetpts=PTS-STARTPTS[a%d]', start_s, end_s, seg_idx::bigint, start_s, end_s, seg_idx::bigint), ';' order by seg_idx)
       || ';' || string_agg(printf('[v%d][a%d]', seg_idx::bigint, seg_idx::bigint), '' order by seg_idx) || printf('concat=n=%d:v=1:a=1[v][a]', count(*)) as graph from keeps group by 1""",
)
ORACLES["clip_lengths"] = _with(_EV, "select event_id, floor(value / 10)::bigint as duration from ev where floor(value / 10) >= 20 and value / 10 - event_id % 4 >= 20")
ORACLES["result_arrays"] = _with(
    _EV + ", r as (select *, row_number() over (partition by source_id order by value desc, event_id) as rank from ev)",
    "select source_id, to_json(list({'rank': rank, 'hit_id': event_id, 'detector': event_type} order by rank))::varchar as value from r where rank <= 3 group by 1",
)
ORACLES["report"] = _with(
    _EV + """, r as (select *, row_number() over (order by value desc, event_id) as rank from ev),
    best as (select rank, value / 5 as final_score, t, t + 30 as e, event_type, floor(value / 50) as p1, (event_id % 10)::double as p2 from r where rank <= 5)""",
    """select rank, unnest([0, 1, 2, 3]) as line_no, unnest([
         printf('#%d - SCORE: %d/100', rank, round_even(final_score, 0)::bigint),
         printf('Time: %02d:%02d:%02d - %02d:%02d:%02d', floor(t / 3600)::bigint, (floor(t / 60) % 60)::bigint, (floor(t) % 60)::bigint, floor(e / 3600)::bigint, (floor(e / 60) % 60)::bigint, (floor(e) % 60)::bigint),
         'Hook: ' || event_type, printf('Phase scores: text=%.1f, audio=%.1f', p1, p2)]) as line from best""",
)
ORACLES["records"] = _with(_EV, "select event_id, to_json({'event_id': event_id, 'event_type': event_type, 'props': props})::varchar as record from ev")
ORACLES["faces_by_x"] = _with(_FACES, "select source_id, g as idx, row_number() over (partition by source_id, g order by cx, idx) - 1 as place, idx as face_idx, round(cx, 6) as cx from face")
ORACLES["first_face"] = _with(
    _FACES + ", one as (select source_id, g, arg_min(cx / 1920, idx) filter (score >= 0.6) as cx from face group by all)",
    "select source_id, g as idx, round(coalesce(last_value(cx ignore nulls) over (partition by source_id order by g rows unbounded preceding), 0.5), 6) as cx from one",
)
ORACLES["mean_crop"] = (
    "select source_id, greatest(0, least(trunc(avg(value) / 500 * 1920 - 607 / 2.0::double)::bigint, 1920 - 607)) as crop_x from ("
    + ORACLES["interp_linear"].replace("round(case", "(case").replace("end, 6) as value", "end) as value")
    + ") group by 1"
)
ORACLES["segment_at_frame"] = _with(
    _NUM + ", size as (select source_id, count(*) as n from ev group by 1), seg as (select source_id, idx // 7 as seg_idx, floor(min(value))::bigint as crop_x from num join size using (source_id) where idx < n - n % 7 - 7 group by all), last as (select source_id, max(seg_idx) as top from seg group by 1)",
    "select num.source_id, num.idx as frame_idx, seg.seg_idx, seg.crop_x from num join last using (source_id) join seg on seg.source_id = num.source_id and seg.seg_idx = least(num.idx // 7, top)",
)
ORACLES["sample_slice"] = _with(_NUM, "select source_id, idx, event_id from num where idx >= 12 and idx < 39")
ORACLES["rubric_scores"] = _with(_EV, "select event_id, case when event_id % 7 = 0 then 0 else event_id % 90 end as total, case when event_id % 7 = 0 then 'parse_error' else event_type end as verdict from ev")
ORACLES["detailed_scores"] = _with(_EV, "select event_id, case when event_id % 5 <> 0 then (event_id % 100)::double else (event_id % 11 + event_id % 7) * 5.0::double end as final_score, case when event_id % 5 <> 0 then event_type else 'fallback' end as explanation from ev")
ORACLES["detailed_answers"] = _with(
    _EV + """, a as (select event_id, event_type, event_id % 5 <> 0 and event_id % 7 <> 0 as ok, repeat(event_type || ' ', event_id % 30) as text from ev),
    h as (select *, case when length(text) > 100 then text[1:100] || '...' else text end as hook from a)""",
    """select event_id, case when ok then (event_id % 100)::double else (event_id % 11 + event_id % 7) * 5.0::double end as final_score,
       case when ok then event_id % 31 end as hook_score, case when ok then event_id % 26 end as arc_score, case when ok then event_id % 25 end as emotion_score,
       case when ok then event_id % 11 end as punchline_score, case when ok then event_id % 9 end as value_score, case when ok then event_id % 2 = 0 end as has_conclusion,
       case when ok and event_id % 3 <> 0 then 'h' || event_type else hook end as hook_text, case when ok and event_id % 4 <> 0 then 'q' else '' end as best_quote,
       case when not ok then 'Auto-scored (API error)' when event_id % 6 <> 0 then event_type else '' end as explanation, case when ok then '10-40' end as suggested_trim from h""",
)
ORACLES["full_report"] = _with(
    _EV + """, r as (select *, row_number() over (order by value desc, event_id) as rank from ev),
    best as (select event_id, rank, value / 5 as final_score, t, t + 30 as e, event_type, floor(value / 50) as p1, (event_id % 10)::double as p2 from r where rank <= 5)""",
    """select 0 as rank, unnest([0, 1, 2, 3]) as line_no, unnest(['', repeat('=', 80), '🎯 TOP 5 VIRAL PASSAGES FOR TIKTOK/REELS', repeat('=', 80)]) as line
       union all
       select rank, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as line_no, unnest(['',
         printf('#%d - SCORE: %d/100', rank, round_even(final_score, 0)::bigint),
         printf('⏱️  Time: %02d:%02d:%02d - %02d:%02d:%02d', floor(t / 3600)::bigint, (floor(t / 60) % 60)::bigint, (floor(t) % 60)::bigint, floor(e / 3600)::bigint, (floor(e / 60) % 60)::bigint, (floor(e) % 60)::bigint),
         '🎣 Hook: ' || event_type, '💬 Best Quote: ' || case when event_id % 2 = 0 then 'q' else '' end, printf('📊 Phase Scores: Text=%.1f, Audio=%.1f', p1, p2), '📝 Why: why', repeat('-', 80)]) as line from best""",
)
ORACLES["result_files"] = _with(
    _EV + ", r as (select *, row_number() over (order by value desc, event_id) as rank from ev)",
    """select name, to_json(list({'rank': rank, 'hit_id': event_id, 'detector': event_type} order by rank))::varchar as value
       from r join (values ('final', 5), ('all', 8)) as f(name, n) on rank <= n group by name""",
)
ORACLES["batch_calls"] = _with(
    _BATCH,
    """select batch, id, case when batch % 5 = 0 then 5.0::double when doc_id % 13 = 0 then null else (doc_id % 10 + 1)::double end as score,
       case when batch % 5 = 0 then 'error' when doc_id % 13 = 0 then 'missing' else 'scored' end as status from b""",
)
ORACLES["text_detector"] = """
with s as (select conv_id as source_id, count(*) as n from conversations group by 1 having conv_id % 7 <> 0)
select source_id, 0::bigint as hit_idx, 1.5::double as start_s, n * 2.5::double as end_s, n * 2 as duration_s, 'hook ' || source_id as hook_text, source_id % 101 as score from s
union all select source_id, 1::bigint, n * 1.0::double, n + 20.25::double, n * 2, 'hook ' || source_id, n from s"""
ORACLES["audio_detector"] = _with(
    _EV + ", s as (select source_id, count(*) as n from ev group by 1 having source_id % 7 <> 0)",
    "select source_id, (n * 7)::double as start_s, (n * 7 + 45)::double as end_s, 'p' as punchline, n % 101 as score from s",
)
ORACLES["wrapped_lines"] = _with(
    _WORDS + """,
    need as (select source_id, word_idx, 20.0::double * length(replace(upper(word), 'ẞ', 'SS')) as w from words),
    run as (
      select source_id, -1::bigint as word_idx, 0::bigint as line, 0 as held, 0.0::double as used from (select distinct source_id from words)
      union all
      select source_id, word_idx, case when fresh then 0 when breaks then line + 1 else line end, case when fresh or breaks then 1 else held + 1 end, case when fresh or breaks then w else used + w + 10 end
      from (select r.line, r.held, r.used, n.source_id, n.word_idx, n.w, n.word_idx % 8 = 0 as fresh, r.held = 3 or r.used + 10 + n.w > 300 as breaks
            from run r join need n on n.source_id = r.source_id and n.word_idx = r.word_idx + 1))""",
    "select source_id, word_idx // 8 as group_idx, word_idx, line as line_idx from run where word_idx >= 0",
    recursive=True,
)

# --- streams: what their batch forms give, less what is still open ------------------------

ORACLES["stream_ema"] = ORACLES["ema_series"]
ORACLES["stream_recover"] = ORACLES["track_recover"]
ORACLES["stream_hysteresis"] = ORACLES["hysteresis"]
ORACLES["stream_segments"] = f"select source_id, start_idx, end_idx, crop_x from (select *, max(seg_idx) over (partition by source_id) as open from ({ORACLES['segment_median']})) where seg_idx < open"
ORACLES["stream_dedup"] = f"select source_id, hit_id, start_s, score from (select *, row_number() over (partition by source_id order by start_s desc, hit_id desc) as back from ({ORACLES['near_dedup']})) where back > 1 or start_s + 30 < (select (epoch_us(max(ts)) - 1704067200000000) / 3.6e9 - 10 from events)"
_INSTANT = "inst as (select user_id as source_id, epoch_us(ts) / 1000000 as s, value from events)"
ORACLES["stream_energy"] = _with(_INSTANT.replace("events)", "events)"), "select source_id, (floor(s / 43200) * 43200)::bigint as start, round(sqrt(avg(value * value)), 6) as rms, count(*) as n from inst group by 1, 2")
ORACLES["stream_passages"] = _with(
    _INSTANT + ", placed as (select source_id, value, unnest([floor(s / 72000) * 72000, floor(s / 72000) * 72000 - 72000]) as start, s from inst)",
    "select source_id, start::bigint as start, round(sqrt(avg(value * value)), 6) as rms, count(*) as n from placed where s < start + 108000 group by 1, 2",
)

ORACLES["held_crop"] = _with(
    _NUM + """, known as (select source_id, idx, case when event_id % 3 = 0 then value / 500 * 1920 end as cx from num),
    held as (select *, coalesce(trunc(last_value(cx ignore nulls) over (partition by source_id order by idx rows unbounded preceding)), 960) as last from known)""",
    "select source_id, idx, trunc(greatest(0, least(coalesce(cx, last) - 303.5::double, 1313)))::bigint as crop_x from held",
)
ORACLES["max_clips"] = _with(
    _EV + ", r as (select event_id as hit_id, row_number() over (order by value desc, t, event_id) as rank from ev)",
    "select hit_id, rank from r where rank <= 5 union all select hit_id, rank from r where rank <= 2",
)
