"""The queries of the catalogue in DuckDB's SQL, written apart from their plans."""

from __future__ import annotations

from residua.functions.rademacher import INNER, OUTER
from residua.plans.derive import COUPLED, KEY, PREFIX, STEPS, TOLERANCE
from residua.schema import METRICS
from residua.solvers.multigrid import ORDER

_PAD = KEY.ljust(64, b"\0")
_IN, _OUT = bytes(b ^ INNER for b in _PAD).hex(), bytes(b ^ OUTER for b in _PAD).hex()
_LE8 = " || ".join(f"printf('%02x', (block >> {8 * k}) & 255)" for k in range(8))


def _system(cases: int = 1, diagonal: str = "dominant") -> str:
    case = "l_linenumber::varchar" if cases > 1 else "'0'"
    ids = "select k::varchar as case_id from range(1, 8) r(k)" if cases > 1 else "select '0' as case_id"
    weight = "pow(2.0, ceil(log2(1 + 2 * coalesce(total, 0))))" if diagonal == "dyadic" else "1 + coalesce(total, 0)"
    return f"""size as (select count(*) as n from part),
sizes as (select case_id, n from ({ids}), size),
idx as (select case_id, i from sizes, (select i from size, range(0, n) r(i))),
raw as (select {case} as case_id, (l_partkey % n)::bigint as row, (l_orderkey % n)::bigint as col, l_quantity::double as val from lineitem, size),
off as (select case_id, row, col, sum(val) as val from raw where row <> col group by all having sum(val) <> 0),
tot as (select case_id, row as i, sum(abs(val)) as total from off group by all),
a as (select * from off union all select idx.case_id, idx.i, idx.i, {weight} from idx left join tot on tot.case_id = idx.case_id and tot.i = idx.i),
ramp as (select case_id, i, (i % 11 - 5)::double as x from idx),
blocks as (select block, sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}' || '{PREFIX.hex()}' || {_LE8})))) as h from size, range(0, (n + 255) // 256) b(block)),
sign as (select block * 256 + k as i, (2.0 * ((('0x' || substr(h, (k // 8) * 2 + 1, 2))::int >> (k % 8)::int) & 1) - 1.0)::double as x from blocks, range(0, 256) r(k)),
target as (select idx.case_id, idx.i, sign.x from idx join sign on sign.i = idx.i),
rhs as (select idx.case_id, idx.i, coalesce(s, 0) as x from idx left join (select a.case_id, a.row as i, sum(val * x) as s from a join target t on t.case_id = a.case_id and t.i = a.col group by all) p on p.case_id = idx.case_id and p.i = idx.i)"""


def _spmv(matrix: str, vector: str, expr: str = "m.val * v.x") -> str:
    return f"select idx.case_id, idx.i, coalesce(s, 0.0) as y from idx left join (select m.case_id, m.row as i, sum({expr}) as s from {matrix} m join {vector} v on v.case_id = m.case_id and v.i = m.col group by all) p on p.case_id = idx.case_id and p.i = idx.i"


_SIZE = "case case_id " + " ".join(f"when '{k}' then {0.0 if e is None else 2.0**-e!r}::double" for k, e in enumerate(STEPS, 1)) + " end"
_MEASURED = f"""{_system(7)},
cand as (select case_id, i, x + (i % 7 - 3) * {_SIZE} as x from target),
prod as (select a.case_id, a.row as i, sum(val * x) as ax, sum(abs(val) * abs(x)) as abs_ax, sum(abs(val)) as row_norm from a join cand c on c.case_id = a.case_id and c.i = a.col group by all),
rows_ as (select c.case_id, c.i, c.x, b.x as b, b.x - ax as residual, abs_ax + abs(b.x) as spread, row_norm, t.x as target, c.x - t.x as error
  from cand c join rhs b using (case_id, i) join target t using (case_id, i) join prod p using (case_id, i)),
met as (select case_id, max(abs(residual)) / (max(row_norm) * max(abs(x)) + max(abs(b))) as {METRICS[0]}, max(abs(residual) / spread) as {METRICS[1]},
  sqrt(sum(residual * residual)) / sqrt(sum(b * b)) as {METRICS[2]}, sqrt(sum(error * error)) / sqrt(sum(target * target)) as {METRICS[3]}, max(abs(error)) / max(abs(target)) as {METRICS[4]} from rows_ group by all)"""


def _logs(*names: str) -> str:
    return "with " + _MEASURED + " select case_id, " + ", ".join(f"round(case when {m} = 0 then -400.0 else log10({m}) end, 6) as {m}" for m in names) + " from met"


_MESH = f"""case when {METRICS[0]} > 1e-10 then '{METRICS[0]} exceeds 1e-10' when {METRICS[1]} > 1e-8 then '{METRICS[1]} exceeds 1e-08'
 when {METRICS[3]} > 1e-5 then '{METRICS[3]} exceeds 1e-05' when {METRICS[4]} > 1e-5 then '{METRICS[4]} exceeds 1e-05' end"""
_REPLAY = f"case when {METRICS[0]} > {TOLERANCE!r} then '{METRICS[0]} exceeds 1e-10' when {METRICS[2]} > {TOLERANCE * (1 + 1e-6)!r} then '{METRICS[2]} exceeds 1e-10' end"
_CENTS = "round(value * 100)::bigint * 10000000"
_RUNS = f"""runs as (select user_id::varchar as case_id, case when user_id % 10 = 9 then 'control' else 'scored' end as role, sum({_CENTS})::bigint as reference_ns,
  (sum({_CENTS}) filter (event_id % 2 = 0))::bigint as candidate_ns, 4 * count(*) filter (event_type = 'error') <= count(*) as passed from events group by user_id)"""
_SYM = f"""{_system()},
both_ as (select case_id, row, col, sum(val) as val from (select * from off union all select case_id, col, row, val from off) group by all)"""
_ROUNDED = "select case_id, i, round(x, 5) as x from target"
_IDENT = "with " + _system(7) + " "
#: Rounds of founding that the SQL goes through; the rounds after the last change nothing.
_ROUNDS = 40


def _couplings() -> str:
    return f"""most as (select case_id, row, max(abs(val)) as most from a where row <> col and val <> 0 group by all),
strong as (select a.case_id, a.row as i, a.col as j, abs(val) as size from a join most m on m.case_id = a.case_id and m.row = a.row where a.row <> a.col and val <> 0 and abs(val) >= {COUPLED} * most),
pairs as materialized (select case_id, i, j, max(size) as size from (select * from strong union all select case_id, j, i, size from strong) group by all)"""


def _aggregates() -> str:
    """CTEs up to owners(case_id, i, owner) of the one case '0'."""
    out, place = [_couplings(), "live0 as materialized (select i, j from pairs)"], lambda i: f"({i} * {ORDER} % {1 << 32})"
    for k in range(_ROUNDS):
        out += [
            f"least{k} as materialized (select i, least(min({place('j')}), {place('i')}) as least from live{k} group by i)",
            f"near{k} as materialized (select l.i from live{k} l join least{k} n on n.i = l.j group by l.i having min(n.least) = {place('l.i')})",
            f"new{k} as materialized (select i, i as owner from near{k} union all select l.i, l.j as owner from live{k} l join near{k} n on n.i = l.j)",
            f"live{k + 1} as materialized (select i, j from live{k} where i not in (select i from new{k}) and j not in (select i from new{k}))",
        ]
    out += [
        "founded as materialized (" + " union all ".join(f"select * from new{k}" for k in range(_ROUNDS)) + ")",
        "beside as (select p.i, f.owner, row_number() over (partition by p.i order by p.size desc, p.j) as nth from pairs p join founded f on f.i = p.j where p.i not in (select i from founded))",
        "every as materialized (select idx.case_id, idx.i, coalesce(f.owner, b.owner, idx.i) as owner from idx left join founded f on f.i = idx.i left join beside b on b.i = idx.i and b.nth = 1)",
        "ranks as (select owner, row_number() over (order by owner) - 1 as rank from (select distinct owner from every))",
        "owners as materialized (select case_id, i, rank as owner from every join ranks using (owner))",
        "coarse as materialized (select a.case_id, r.owner as row, c.owner as col, sum(val) as val from a join owners r on r.i = a.row join owners c on c.i = a.col group by all)",
    ]
    return ",\n".join(out)


_ONE = "with " + _system() + " "

ORACLE_SQL: dict[str, str] = {
    "coo_canonicalize": _IDENT + "select case_id, row, col, sum(val) as val from raw group by all having sum(val) <> 0",
    "matrix_stats": _IDENT + "select case_id, n, count(*)::bigint as nnz, max(abs(val)) as max_abs, min(k)::bigint as min_row_nnz, max(k)::bigint as max_row_nnz, count(*) filter (row = col)::bigint as diagonals from (select *, count(*) over (partition by case_id, row) as k from a) join sizes using (case_id) group by case_id, n",
    "matrix_transpose": _IDENT + "select case_id, col as row, row as col, val from a",
    "csr_row_offsets": _IDENT + "select case_id, i, count, (sum(count) over (partition by case_id order by i) - count)::bigint as start from (select idx.case_id, idx.i, count(a.val) as count from idx left join a on a.case_id = idx.case_id and a.row = idx.i group by all)",
    "csr_violations": _IDENT + ", w as (select case_id, row, col + case when row % 5 = 0 then 1000000000 else 0 end as col, val from raw), f as (select w.case_id, w.col >= n as far, row_number() over (partition by w.case_id, row, col order by val) > 1 as again from w join sizes s on s.case_id = w.case_id) select case_id, 'column out of range' as rule, count(*) filter (far)::bigint as count from f group by all having count(*) filter (far) > 0 union all select case_id, 'repeated place', count(*) filter (again)::bigint from f group by all having count(*) filter (again) > 0",
    "spmv": _ONE + _spmv("a", "ramp"),
    "spmv_transpose": _ONE + ", t as (select case_id, col as row, row as col, val from a) " + _spmv("t", "ramp"),
    "spmv_axpby": _ONE + ", t as (select case_id, col as row, row as col, val from a), p as (" + _spmv("t", "ramp") + ") select case_id, i, 2.0::double * y - 0.5::double * x as y from p join ramp using (case_id, i)",
    "abs_spmv": _ONE + _spmv("a", "ramp", "abs(m.val) * abs(v.x)"),
    "inf_norm": _IDENT + "select case_id, max(s) as norm from (select case_id, row, sum(abs(val)) as s from a group by all) group by all",
    "one_norm": _IDENT + "select case_id, max(s) as norm from (select case_id, col, sum(abs(val)) as s from a group by all) group by all",
    "asymmetry": _IDENT + ", m as (select coalesce(x.case_id, y.case_id) as case_id, coalesce(x.val, 0) as val, coalesce(y.val, 0) as mirror from a x full join a y on x.case_id = y.case_id and x.row = y.col and x.col = y.row) select case_id, max(abs(val)) as scale, max(abs(val - mirror)) as asymmetry, max(abs(val)) <> 0 and max(abs(val - mirror)) > 1e-12 * max(abs(val)) as nonsymmetric from m group by all",
    "max_abs": _IDENT + "select case_id, max(abs(x)) as max_abs from rhs group by all",
    "l2_norm": _IDENT + "select case_id, round(sqrt(sum(x * x)), 6) as norm from rhs group by all",
    "dot": _IDENT + "select case_id, sum(rhs.x * ramp.x) as dot from rhs join ramp using (case_id, i) group by all",
    "mass_dot": _ONE + ", basis as (select case_id, 'ramp' as name, i, x from ramp union all select case_id, 'target', i, x from target union all select case_id, 'steep', i, 3 * x from ramp) select basis.case_id, name, sum(basis.x * r.x) as with_ramp, sum(basis.x * t.x) as with_target from basis join ramp r on r.i = basis.i join target t on t.i = basis.i group by all",
    "tagged_dot": _ONE + "select case_id, i % 4 as tag, sum(r.x * t.x) as dot from ramp r join target t using (case_id, i) group by all",
    "axpy": _ONE + "select case_id, i, 0.5::double * t.x + r.x as x from ramp r join target t using (case_id, i)",
    "mass_axpy": _ONE + "select case_id, i, 0.5::double * r.x - 2.0::double * t.x + 0.75::double * r.x + t.x as x from ramp r join target t using (case_id, i)",
    "scale": _ONE + "select case_id, i, -0.25::double * x as x from ramp",
    "diag_extract": _IDENT + "select case_id, row as i, val as x from a where row = col",
    "diag_scale": "with " + _system(1, "dyadic") + " select case_id, ramp.i, x / val as x from ramp join a using (case_id) where a.row = ramp.i and a.col = ramp.i",
    "constant_vector": _ONE + "select case_id, i, 0.0::double as x from idx",
    "rademacher_target": _ONE + "select case_id, i, x::double as x from target",
    "manufactured_rhs": _ONE + "select case_id, i, x::double as x from rhs",
    "residual": "with " + _MEASURED + " select case_id, i, residual, round(spread, 6) as spread, row_norm from rows_",
    "normwise_error": _logs(METRICS[0]),
    "componentwise_error": _logs(METRICS[1]),
    "relative_residual": _logs(METRICS[2]),
    "forward_errors": _logs(*METRICS[3:]),
    "metrics_bundle": _logs(*METRICS),
    "accuracy_verdict": f"with {_MEASURED} select case_id, f is null as passed, f as failure from (select case_id, {_MESH} as f from met)",
    "replay_verdict": f"with {_MEASURED} select case_id, f is null as passed, f as failure from (select case_id, {_REPLAY} as f from met)",
    "verdict_cascade": f"with {_MEASURED} select case_id, f is null as passed, f as failure from (select case_id, case case_id when '1' then 'process failed' when '2' then 'missing driver output' when '3' then 'driver output has the wrong size' when '4' then 'solver returned an error' when '5' then 'solver mutated its input' when '6' then 'solution is not finite' else {_MESH} end as f from met)",
    "output_checks": "select o_orderkey, case when o_orderkey % 17 = 0 then 'driver output has the wrong size' when o_orderkey % 19 = 0 then 'driver output header is invalid' when o_orderkey % 23 = 0 or o_orderkey % 11 = 0 or (o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3) = 0 then 'driver timing or mutation fields are invalid' end as error from orders",
    "finite_solution": _IDENT + "select case_id, case_id not in ('3', '6') as finite from sizes",
    "jacobi_sweeps_3": "with " + _system(1, "dyadic") + ", dg as (select row as i, val as d from a where row = col), x1 as (select ramp.i, ramp.x / d as x from ramp join dg using (i)), x2 as (select ramp.i, (ramp.x - coalesce(s, 0)) / d as x from ramp join dg using (i) left join (select row as i, sum(val * x1.x) as s from off join x1 on x1.i = off.col group by all) p using (i)) select '0' as case_id, ramp.i, (ramp.x - coalesce(s, 0)) / d as x from ramp join dg using (i) left join (select row as i, sum(val * x2.x) as s from off join x2 on x2.i = off.col group by all) p using (i)",
    "rayleigh_quotient": _IDENT + ", p as (" + _spmv("a", "ramp") + ") select case_id, round(sum(x * y) / sum(x * x), 6) as quotient from p join ramp using (case_id, i) group by all",
    "warmstart_rescale": _IDENT + ", p as (" + _spmv("a", "ramp") + ") select case_id, round(sum(x * y) / sum(y * y), 9) as alpha from p join rhs using (case_id, i) group by all",
    "diag_defect": _IDENT + ", z as (select case_id, rhs.i, x as r, x / val as z from rhs join a using (case_id) where a.row = rhs.i and a.col = rhs.i) select case_id, round(1 - pow(sum(r * z), 2) / (sum(r * r) * sum(z * z)), 9) as defect from z group by all",
    "solve_bicgstab": _IDENT + _ROUNDED,
    "solve_gmres": _IDENT + _ROUNDED,
    "solve_fgmres": _IDENT + _ROUNDED,
    "solve_pcg": _ONE + _ROUNDED,
    "archive_scan": _IDENT + "select case when case_id < '5' then 'm' || case_id || '.tar.gz' else 'rest.zip' end as archive, 'm' || case_id as case_id, row, col, val from a where case_id in ('2', '5', '7')",
    "solve_cg_distributed": _ONE + _ROUNDED,
    "solve_gmres_distributed": _ONE + _ROUNDED,
    "multigrid_couplings": "with " + _system(7) + ", " + _couplings() + " select case_id, i, j, size from pairs",
    "multigrid_aggregates": "with " + _system() + ", " + _aggregates() + " select case_id, i, owner from owners",
    "multigrid_coarse": "with " + _system() + ", " + _aggregates() + " select case_id, row, col, val from coarse",
    "multigrid_levels": "with " + _system() + ", " + _aggregates() + " select case_id, 0 as level, any_value(n) as n, count(*) as nnz, sum(abs(val)) as total from a join sizes using (case_id) group by case_id union all select case_id, 1, (select count(distinct owner) from owners), count(*), sum(abs(val)) from coarse group by case_id",
    "solver_runs": "select k::varchar as case_id, 0::int as status, 0::int as returncode, false as mutated from range(1, 8) r(k)",
    "solve_and_verify": "select k::varchar as case_id, true as passed, null::varchar as failure from range(1, 8) r(k)",
    "cost_switch": f"with {_RUNS}, c as (select case_id, 1 + reference_ns / 1e12::double as k from runs), s as (select case_id, greatest(1.0::double, acosh(1e10::double) / -ln((sqrt(k) - 1) / (sqrt(k) + 1))) as steps from c) select case_id, round(steps, 4) as steps, case when steps <= 40 + sqrt(steps) * 5 then 'first' else 'second' end as choice from s",
    "case_speedup": f"with {_RUNS} select case_id, role, passed, case when passed then round(reference_ns::double / candidate_ns::double, 6) end as speedup from runs",
    "runtime_speedup": f"with {_RUNS}, g as (select true as complete, bool_and(passed) as all_passed, sum(reference_ns) filter (role = 'scored') as r, sum(candidate_ns) filter (role = 'scored') as c from runs) select case when all_passed then r::double / c::double end as value, case when all_passed then r::bigint end as total_reference_ns, case when all_passed then c::bigint end as total_candidate_ns, complete, all_passed from g",
    "runtime_speedup_of_passing": f"with {_RUNS} select round((sum(reference_ns) filter (role = 'scored'))::double / (sum(candidate_ns) filter (role = 'scored'))::double, 9) as value, (sum(reference_ns) filter (role = 'scored'))::bigint as total_reference_ns, (sum(candidate_ns) filter (role = 'scored'))::bigint as total_candidate_ns, true as complete, true as all_passed from runs where passed",
    "cases_solved": f"with {_RUNS} select (count(*) filter (role = 'scored' and passed))::bigint as value, (count(*) filter (role = 'scored' and passed))::bigint as solved_cases, (count(*) filter (role = 'scored'))::bigint as evaluated_cases, (count(*) filter (role = 'scored'))::bigint as total_cases, true as complete, bool_and(passed) as all_passed from runs",
    "completeness": "select count(*) filter (user_id = 3) = 0 as complete from events",
    "totals": f"with {_RUNS} select sum(reference_ns)::bigint as reference_ns, sum(candidate_ns)::bigint as candidate_ns, count(*)::bigint as cases from runs where role = 'scored'",
    "ordered_rows": "select true as ordered",
    "paired_results": f"with {_RUNS} select case_id, passed, candidate_ns, case when not passed then 'solution is not finite' end as failure, reference_ns, true as reference_passed from runs",
    "best_candidate": "select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity from lineitem qualify row_number() over (partition by l_partkey order by l_quantity desc nulls last, l_orderkey, l_linenumber) = 1",
    "running_best": "select event_id, user_id, min(value) over (partition by user_id order by event_id rows unbounded preceding) as best, lag(value, 8) over (partition by user_id order by event_id) as eight_before from events",
    "case_select": "select distinct user_id::varchar as case_id, case when user_id % 10 = 9 then 'control' else 'scored' end as role, user_id::int as idx from events where user_id % 3 = 0",
    "unknown_cases": "select distinct (user_id * 2)::varchar as case_id from events where user_id * 2 not in (select user_id from events)",
    "duplicate_ids": "select l_orderkey, count(*)::bigint as count from lineitem group by all having count(*) > 1",
    "manifest_violations": """with o as (select o_orderkey as k, (o_orderkey - o_orderkey % 2 * case when o_orderkey % 10 = 1 then 1 else 0 end)::varchar as case_id from orders)
select case_id, 'index is not its position' as rule from o where k % 13 = 0 union all select case_id, 'size is not positive' from o where k % 29 = 0 union all select case_id, 'entries are not positive' from o where k % 31 <= 1
union all select case_id, 'tolerance is not between 0 and 1' from o where k % 37 = 0 union all select case_id, 'role is unknown' from o where k % 41 = 0 union all select case_id, 'digest is malformed' from o where k % 43 = 0
union all select case_id, 'id is repeated' from o group by case_id having count(*) > 1""",
    "run_coverage": "with p as (select distinct user_id as u, case when user_id % 10 = 9 then 'control' else 'scored' end as role from events), q as (select u + 2 as u, role from p) select u::varchar as case_id, role, 'missing' as problem from (select * from p except select * from q) union all select u::varchar, role, 'unexpected' from (select * from q except select * from p)",
    "forbidden_names": "select distinct n_name as name from nation where not substr(n_name, 1, 1) < 'F' and n_name not in (select r_name from region)",
    "changed_metadata": "select n_nationkey::varchar as case_id, 'name' as field from nation where n_nationkey % 4 = 0 union all select n_nationkey::varchar, 'region' from nation where n_nationkey % 3 = 0",
    "diagnostics_tail": "select doc_id as case_id, length(right(text, 8000))::int as kept, md5(right(text, 8000)) as digest from documents",
    "source_audit": """with s as (select doc_id, (case when doc_id % 3 = 0 then '#include <a.h>' || chr(10) else '' end) || (case when doc_id % 5 = 0 then '  # include "b.h"' || chr(10) else '' end) || text || (case when doc_id % 7 = 0 then chr(13) else '' end) || chr(10) as t from documents)
select doc_id::varchar as name, 'too long' as rule from s where octet_length(encode(t)) > 8000 union all select doc_id::varchar, 'line ends are not LF' from s where contains(t, chr(13))
union all select doc_id::varchar, 'must include exactly one header' from s where len(regexp_extract_all(t, '(?m)^[ \\t]*#[ \\t]*include\\b')) <> 1""",
    "submission_audit": "select (case when c_custkey % 7 = 0 then 'Bad Name' else 'solver-' end) || c_custkey::varchar as name, 'name is malformed' as rule from customer where c_custkey % 7 = 0 union all select (case when c_custkey % 7 = 0 then 'Bad Name' else 'solver-' end) || c_custkey::varchar, 'submitter is blank' from customer where c_custkey % 11 = 0 union all select (case when c_custkey % 7 = 0 then 'Bad Name' else 'solver-' end) || c_custkey::varchar, 'unknown family' from customer where c_custkey % 13 = 0",
    "wire_roundtrip": _IDENT + "select a.case_id, any_value(n) as n, count(*)::bigint as nnz, sum(val) as sum_val, any_value(sb) as sum_b from a join sizes using (case_id) join (select case_id, sum(x) as sb from rhs group by all) using (case_id) group by all",
    "solve_multigrid": _IDENT + _ROUNDED,
    "solve_ilu": _IDENT + _ROUNDED,
    "fsai_identity": "with " + _system() + ", both_ as (select row, col, val from raw where row <> col union all select col, row, val from raw where row <> col), places as (select row, col from both_ where col < row group by row, col having sum(val) <> 0) select '0' as case_id, row, col, 0.0::double as identity from places union all select case_id, i, i, 1.0::double from idx",
    "exact_sums": f"select l_returnflag, l_linenumber, round(cast(sum(cast(l_extendedprice::double * {1 << 40} as hugeint)) as double) / {1 << 40}, 3) as total from lineitem group by all",
    "solve_chebyshev": _ONE + _ROUNDED,
    "solve_cheapest": _ONE + _ROUNDED,
    "solve_switching": _ONE + _ROUNDED,
    "solve_switching_nonsymmetric": _IDENT + _ROUNDED,
    "solve_schwarz": _ONE + _ROUNDED,
    "schwarz_overlap": "with " + _system(7) + ", " + _couplings() + """, few as (select case_id, i from pairs group by all having count(*) <= 6),
links as (select p.case_id, p.i, p.j from pairs p join few f using (case_id, i) join few g on g.case_id = p.case_id and g.i = p.j),
part0 as (select case_id, i // 16 as part, i, true as own from idx),
part1 as materialized (select case_id, part, i, bool_or(own) as own from (select * from part0 union all select l.case_id, part, l.j, false from part0 join links l using (case_id, i)) group by all),
part2 as (select case_id, part, i, bool_or(own) as own from (select * from part1 union all select l.case_id, part, l.j, false from part1 join links l using (case_id, i)) group by all)
select case_id, part, i, own from part2""",
    "verdict_fail_closed": f"select k::varchar as case_id, k >= 6 as passed, case when k < 6 then 'invalid {METRICS[0]}' end as failure from range(1, 8) r(k)",
    "case_pipeline": _IDENT + """, s as (select case_id, count(*)::bigint as entries, sum(val) as sum_val from a group by all)
select case_id, n, case when case_id < '5' then 64 end::int as identity, case when case_id < '5' then entries end as entries, case when case_id < '5' then sum_val end as sum_val,
 case when case_id < '5' then n::double end as signs, case when case_id < '5' then true end as b_holds,
 case case_id when '5' then 'fault: the number of entries is not that of the manifest' when '6' then 'fault: the matrix is not that of the manifest' when '7' then 'there is no archive' end as wrong from sizes join s using (case_id)""",
    "matrix_market_load": _ONE + "select case_id, row, col, val from a",
    "execution_violations": "select o_orderkey::varchar as case_id, 'there is no return code' as rule from orders where o_orderkey % 7 = 0 union all select o_orderkey::varchar, 'seconds are not finite and positive' from orders where o_orderkey % 11 = 0 or o_orderkey % 13 = 0 union all select o_orderkey::varchar, 'there are no diagnostics' from orders where o_orderkey % 17 = 0",
    "input_violations": "with o as (select o_orderkey as k from orders where o_orderkey % 19 <> 0) select k::varchar as case_id, 'tolerance is not between 0 and 1' as rule from o where k % 5 = 0 union all select k::varchar, 'vectors are not as long as the matrix' from o where k % 7 = 0 union all select k::varchar, 'vectors are not finite' from o where k % 11 = 0 union all select distinct 'caf\u00e9', 'id is not ASCII' from orders where o_orderkey % 19 = 0",
    "resource_violations": "select o_orderkey::varchar as name, 'cpus are not positive' as rule from orders where o_orderkey % 5 = 0 union all select o_orderkey::varchar, 'memory is not a positive multiple of a mebibyte' from orders where o_orderkey % 7 = 0",
    "common_names": "select l_partkey::varchar as name from lineitem where l_linenumber = 1 intersect select l_partkey::varchar from lineitem where l_linenumber = 2 intersect select l_partkey::varchar from lineitem where l_linenumber = 3",
    "merged_identities": "select n_nationkey, 'key,name,region' as keys, lower(n_name) as name, n_nationkey::varchar as key, n_regionkey::varchar as region from nation",
    "reference_gate": "select distinct user_id::varchar as case_id from events where user_id % 17 = 3",
    "execution_statistics": f"with {_RUNS} select role, passed, count(*)::bigint as runs, round(sum(candidate_ns / 1e9), 6) as total_seconds, round(max(candidate_ns / 1e9), 6) as longest_seconds, round(sum(candidate_ns / 1e9) / (select sum(candidate_ns / 1e9) from runs), 9) as share from runs group by all",
}
