"""The derived tables of ``inputs`` again, as SQL common table expressions for the oracle."""

from __future__ import annotations


def hex32(parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) as bigint)"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


UTILITY = """utility as (
  select *, 'm' || cast(prompt_id % 3 as varchar) as model, 'd' || cast((prompt_id // 3) % 2 as varchar) as dataset
  from (select event_id // 64 as prompt_id, cast(event_id % 64 as integer) as k,
               cast(case when event_type = 'purchase' and value > 60 then 1.0 else 0.0 end as double) as u,
               cast(case when event_type = 'purchase' and value > 60 then 1.0
                         when event_type = 'signup' and value > 60 then 0.5 else 0.0 end as double) as u3
        from events))"""

PROMPT_GAP = """prompt_gap as (
  select model, dataset, prompt_id, max(u) as u_circ, avg(u) as u_bar, max(u) - avg(u) as r_hat, count(*) as n_samples
  from utility group by all)"""

FORMS = """forms as (
  select o_orderkey // 64 as prompt_id, cast(o_orderkey % 64 as integer) as k, cast((o_orderkey // 64) % 5 as integer) as g,
         cast(cast(floor(o_totalprice) as bigint) % 5 as integer) as q, cast(o_custkey % 6 as integer) as f
  from orders)"""

# Every line item is an answer; (prompt_id, k) repeats.
LINE_FORMS = """forms as (
  select l_orderkey as prompt_id, cast(l_linenumber as integer) as k, cast(l_orderkey % 5 as integer) as g,
         cast(l_quantity as integer) % 5 as q, cast(l_partkey % 6 as integer) as f
  from lineitem)"""

SAMPLES = """samples as (
  select prompt_id, k,
         case when f = 0 then 'Work 1,200 then' || chr(10) || '#### ' || q
              when f = 1 then 'so ' || chr(92) || 'boxed{' || q || '.0}'
              when f = 2 then 'The answer is $' || q || ' of 99'
              when f = 3 then 'we had 7 and get ' || q || '.'
              when f = 4 then 'paid ' || q || ' then lost -$50'
              else 'no idea' end as text,
         'explained' || chr(10) || '#### ' || g as ground_truth
  from forms)"""

BOXED = """boxed as (
  select prompt_id, k,
         case when f = 0 then 'x ' || chr(92) || 'boxed{' || q || '}'
              when f = 1 then chr(92) || 'boxed{' || chr(92) || 'frac{' || q || '}{2}}'
              when f = 2 then chr(92) || 'boxed{9} then ' || chr(92) || 'boxed { ' || q || ' }'
              when f = 3 then chr(92) || 'boxed{' || q || '} then ' || chr(92) || 'boxed{open'
              when f = 4 then chr(92) || 'boxed{open ' || chr(92) || 'boxed{' || q || '}'
              else 'nothing' end as text,
         case when g = 3 then chr(92) || 'frac{' || g || '}{2}' else cast(g as varchar) end as ground_truth
  from forms)"""

SHAPES = """shapes as (
  select prompt_id, k,
         case when f = 0 then 'maybe (E)? Final answer: (' || chr(65 + q) || ')'
              when f = 1 then 'Final answer: ' || chr(65 + q)
              when f = 2 then 'Final answer: invalid'
              when f = 3 then 'thus the answer is: valid.'
              when f = 4 then 'So far 3. Answer - ' || q
              else 'reasoning' || chr(10) || 'No' end as text,
         case when prompt_id % 3 = 0 then '(' || chr(65 + g) || ')'
              when prompt_id % 3 = 1 then case when g < 2 then 'valid' else 'No' end
              else cast(g as varchar) end as ground_truth
  from forms)"""

CALLS = f"""calls as (
  select *, {hex32("0, prompt_id, k, l")} % 2 = 1 as a_is_candidate,
         'm' || cast(prompt_id % 3 as varchar) as model, 'd' || cast((prompt_id // 3) % 2 as varchar) as dataset
  from (select event_id // 45 as prompt_id, cast(event_id % 45 // 5 as integer) as k, cast(event_id % 5 as integer) as l,
               case event_type when 'click' then 'A' when 'view' then ' b' when 'error' then 'T' when 'signup' then '????' when 'purchase' then 'A.' end as verdict_text
        from events))"""

VOTES = """votes as (
  select *, coalesce(verdict, 0.5) as vote from (
    select *, cast(case upper(substr(trim(verdict_text), 1, 1))
                     when 'A' then case when a_is_candidate then 1.0 else 0.0 end
                     when 'B' then case when a_is_candidate then 0.0 else 1.0 end
                     when 'T' then 0.5 end as double) as verdict
    from calls))"""

COUNTS = """counts as (
  select model, dataset, prompt_id, k,
         count(*) filter (vote = 1) as n_win, count(*) filter (vote = 0) as n_lose,
         count(*) filter (vote = 0.5) as n_tie, count(*) as n_votes
  from votes group by all)"""

AUDIT = """audit as (
  select event_id as ingest_seq, ts,
         'h1_m' || cast(user_id % 3 as varchar) || '_uf_seed' || cast(event_id % 2 as varchar) as experiment,
         user_id as prompt_id, cast(event_id % 16 as integer) as k,
         case when event_type = 'error' then null when event_type = 'view' then 'ABT' else 'ABTAA' end as verdicts,
         cast(case when value > 60 then 1 else 0 end as double) as utility
  from events)"""

OUTCOMES = """outcomes as (
  select l_orderkey as prompt_id, 0 as k, l_linenumber::bigint * 1000000000 + l_partkey as test_idx,
         case when l_returnflag = 'N' then 'functional' when l_discount > 0.099 then 'exotic' else 'stdin' end as testtype,
         case when l_tax > 0.079 then 1 else 0 end as returncode,
         case when l_returnflag = 'N' then '[' || bit || ', 1]' else bit || ' ' || chr(10) end as stdout,
         case when l_returnflag = 'N' then '[0,1]' else '0' || chr(10) end as expected,
         l_quantity / 4 as seconds
  from (select *, case when cast(l_quantity as integer) % 7 = 0 then '1' else '0' end as bit from lineitem))"""

RESULTS = """results as (
  select *, rvr - ci_down as ci_low, rvr + ci_down * 2 as ci_high from (
    select *, reu - aeu as rvr, model || '_' || dataset_id || '_seed' || seed || '_f' || n as file_name from (
      select 'h' || cast(s % 4 + 1 as varchar) as hyp, 'm' || cast(s % 5 as varchar) as model,
             'd' || cast(d % 4 as varchar) || case when d >= 4 then '_judge-x' else '' end as dataset_id,
             'd' || cast(d % 4 as varchar) as dataset, cast(n // 6 as integer) as seed,
             case when s % 4 = 1 then case n % 3 when 0 then 'sft' when 1 then 'dpo' else 'rlvr' end end as stage,
             case when s % 4 = 2 then case when n % 2 = 0 then 'sc' else 'direct' end end as procedure,
             cast(case when s % 4 = 2 and n % 2 = 1 then case (n // 2) % 3 when 0 then 0.0 when 1 then 0.7 else 1.0 end end as double) as tau,
             case when s % 4 = 2 and n % 2 = 0 then case (n // 2) % 3 when 0 then 2 when 1 then 4 else 8 end end as sc_n,
             case when s % 4 = 3 then case n % 7 when 0 then 0 when 1 then 64 when 2 then 128 when 3 then 256
                                               when 4 then 512 when 5 then 1024 else 2048 end end as length,
             0.5::double + disc::double / cnt / 20 as reu, tax::double / cnt / 20 as aeu,
             cast(case when n % 5 <> 0 then 0.01 end as double) as ci_down,
             case when s % 4 <> 2 and (s % 4 <> 3 or n % 2 = 0) then qty::double end as sampling_seconds, n
      from (select l_suppkey % 20 as s, l_partkey % 6 as d, l_linenumber as n,
                   sum(cast(round(l_discount * 100) as bigint)) as disc, sum(cast(round(l_tax * 100) as bigint)) as tax,
                   sum(cast(l_quantity as bigint)) as qty, count(*) as cnt
            from lineitem group by all))))"""

CURVE = """curve as (
  select r.*, cast(k.k as integer) as k_prefix, reu - (8 - k.k)::double / 64 as u_circ, aeu as u_bar
  from results r, (values (1), (2), (4), (8)) k(k)
  where not (r.n % 2 = 0 and k.k = 4))"""

COMPUTE = """compute as (
  select o_orderkey as ingest_seq,
         'h' || cast(o_custkey % 6 + 1 as varchar) || '_m' || cast(o_custkey % 4 as varchar) || '_' || o_orderpriority as experiment,
         o_orderkey % 3 as seed, floor(o_totalprice) / 1024 as gpu_hours
  from orders)"""


def config_json(key: str) -> str:
    return (
        f"""'{{"K":64,"dataset":"d' || cast({key} % 7 as varchar) || '"' || """
        f"""case when {key} % 2 = 0 then ',"max_reasoning_length":' || cast({key} % 3 * 64 as varchar) else '' end || """
        f"""',"max_tokens":1024,"model":"org/m' || cast({key} as varchar) || '","num_prompts":' || cast({key} % 100 + 1 as varchar) || """
        f"""',"prompt_template_version":"v1","seed":' || cast({key} % 5 as varchar) || ',"temperature":' || """
        f"""cast(({key} % 4) / 4.0 as double)::varchar || ',"top_k":-1,"top_p":1.0}}'"""
    )


def fingerprint(key: str) -> str:
    return f"substr(sha256({config_json(key)}), 1, 16)"


def bootstrap(source: str, cell: str, value: str = "r_hat", n: int = 1000, seed: int = 0) -> str:
    """CTEs ``boot_means`` and ``boot_ci`` for a per-prompt source: the first M strokes of the prompts' clocks, by brute force."""
    same = " and ".join(f"p.{c} is not distinct from s.{c}" for c in cell.split(", "))
    cells = lambda of: ", ".join(f"{of}.{c}" for c in cell.split(", "))
    part = lambda i: f"cast('0x' || substr(h, 1 + 8 * {i}, 8) as bigint)"
    masses = lambda rate: f"""list_filter(list_transform(range(0, 100), lambda i: cast(ceil(
        list_sum(list_transform(range(0, i + 1), lambda j: exp(-({rate})) * pow({rate}, j) / gamma(j + 1))) * 4294967296.0::double - 0.5) as bigint)),
        lambda x: x < 4294967296)"""  # noqa: E731
    return f"""boot_sizes as (
  select *, {masses("starts")} as early, {masses("ends - starts")} as late
  from (select {cell}, count(*) as m, greatest(0.0, 1 - 3 / sqrt(count(*))) as starts, (count(*) + 3 * sqrt(count(*)) + 5) / count(*) as ends
        from {source} group by all)),
boot_drawn as (
  select * exclude (h, early, late), len(list_filter(early, lambda x: x <= {part("(2 * (b % 2))::int")})) as n_early,
         len(list_filter(late, lambda x: x <= {part("(2 * (b % 2) + 1)::int")})) as n_late
  from (select {cells("p")}, p.prompt_id, p.{value} as v, s.m, s.early, s.late, r.range as b, md5(concat_ws('|', {seed}, r.range // 2, p.prompt_id)) as h
        from {source} p join boot_sizes s on {same}, range({n + n // 32 + 16}) r)),
boot_strokes as (
  select {cell}, b, m, -1 as stroke_at, null as who, 0 as nth, sum(n_early) as w, sum(n_early * v) as total from boot_drawn group by all
  union all
  select {cell}, b, m, {hex32(f"{seed}, b, prompt_id, nth")}, prompt_id, nth, 1, v
  from (select *, unnest(range(1, n_late + 1)) as nth from boot_drawn)),
boot_means as (
  select {cell}, b, sum(total) / m as resample_mean
  from (select *, sum(w) over (partition by {cell}, b order by stroke_at, who, nth rows unbounded preceding) as so_far from boot_strokes)
  where so_far <= m group by {cell}, b, m having sum(w) = m
  qualify row_number() over (partition by {cell} order by b) <= {n}),
boot_ci as (
  select {cell}, avg(resample_mean) as mean, quantile_cont(resample_mean, 0.025) as ci_low,
         quantile_cont(resample_mean, 0.975) as ci_high
  from boot_means group by all)"""
