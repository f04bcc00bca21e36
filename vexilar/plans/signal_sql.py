"""SQL for the signal features, over a table r (id, i, q) of records of 32 samples: one row a sample, then sums."""

from __future__ import annotations

EPS, WIDE = "1e-8", "1e-6"


def _moments(x: str, mean: str, std: str, eps: str) -> tuple[str, str]:
    return tuple(f"avg(pow(({x} - {mean}) / ({std} + {eps}), {k}))" for k in (3, 4))


def _base() -> dict[str, str]:
    skew, kurtosis = _moments("amp", "am", "asd", EPS)
    return {
        "amp_mean": "any_value(am)", "amp_std": "any_value(asd)", "amp_max": "max(amp)", "amp_min": "min(amp)", "amp_rms": f"sqrt(avg(amp * amp) + {EPS})",
        "papr": f"max(amp * amp) / (avg(amp * amp) + {EPS})", "amp_skew": skew, "amp_kurtosis": kurtosis, "phase_mean": "any_value(pm)", "phase_std": "any_value(psd)",
        "freq_offset_mean": "any_value(tm)", "freq_offset_std": "any_value(tsd)", "i_power": "avg(i * i)", "q_power": "avg(q * q)", "iq_power_ratio": f"avg(i * i) / (avg(q * q) + {EPS})",
        "iq_power_diff": "abs(avg(i * i) - avg(q * q))", "i_mean": "any_value(im)", "q_mean": "any_value(qm)", "i_std": "stddev_pop(i)", "q_std": "stddev_pop(q)",
        "iq_corr": f"avg((i - im) * (q - qm)) / (stddev_pop(i) * stddev_pop(q) + {EPS})",
    }


def _wide() -> dict[str, str]:
    out = {}
    for name, x, mean, std in (("envelope", "env", "em", "esd"), ("phase", "phase", "pm", "psd"), ("turn", "turn", "tm", "tsd")):
        skew, kurtosis = _moments(x, mean, std, WIDE)
        stats = {"mean": f"any_value({mean})", "std": f"any_value({std})", "skew": skew, "kurtosis": kurtosis, "q25": f"quantile_cont({x}, 0.25)", "q75": f"quantile_cont({x}, 0.75)", "peak": f"max(abs({x}))", "power": f"avg({x} * {x})"}
        out |= {f"wide_{name}_{s}": sql for s, sql in stats.items()}
    return out


def _pulse() -> dict[str, str]:
    later = "FILTER (t > 0)"
    out = {
        "tr_span_80": "any_value(q90 - q10)", "tr_span_50": "any_value(q75 - q25)", "tr_crest": f"any_value(q99 / (q50 + {EPS}))", "tr_papr": f"max(p) / (avg(p) + {EPS})", "tr_duty": "avg(CAST(act AS INT))",
        "tr_transition_rate": f"avg(CAST(act <> pact AS INT)) {later}", "tr_edge_mean": "avg(abs(edge))", "tr_edge_std": "stddev_pop(abs(edge))", "tr_edge_q90": "quantile_cont(abs(edge), 0.9)", "tr_edge_max": "max(abs(edge))",
        "tr_rise_mean": f"avg(greatest(edge, 0)) {later}", "tr_rise_std": f"stddev_pop(greatest(edge, 0)) {later}", "tr_fall_mean": f"avg(greatest(-edge, 0)) {later}", "tr_fall_std": f"stddev_pop(greatest(-edge, 0)) {later}",
    }
    for name, x, on, mean, n in (("step", "st", "son", "sm", "sn"), ("drift", "dr", "don", "dm", "dn")):
        total = lambda e, on=on: f"coalesce(sum({e}) FILTER ({on}), 0)"
        out |= {f"osc_{name}_mean": f"any_value({mean})", f"osc_{name}_std": f"sqrt({total(f'pow({x} - {mean}, 2)')} / any_value({n}) + {EPS})", f"osc_{name}_mad": f"{total(f'abs({x} - {mean})')} / any_value({n})"}
    return out | {"osc_step_abs": "avg(abs(st))", "osc_step_all_std": "stddev_pop(st)"}


#: Over the second moments of a record, c: ii, qq, iq, total (ii + qq + eps), gap (size of the pseudo-covariance), im, qm.
HARDWARE = {
    "iq_log_power_ratio": f"ln((ii + {EPS}) / (qq + {EPS}))", "iq_power_difference": "(ii - qq) / total", "iq_correlation": f"iq / (sqrt(ii * qq) + {EPS})", "iq_pseudo_share": "gap / total",
    "iq_pseudo_angle": "atan2(2 * iq, ii - qq)", "iq_dc_leakage": f"sqrt(im * im + qm * qm) / (sqrt(total) + {EPS})", "iq_eigen_ratio": f"(total + gap) / (total - gap + {EPS})",
}
#: Over the spectrum of a record: share and place in both orders, and distances from the centroids.
SPECTRUM = {
    "spectral_entropy": f"-sum(share * ln(share + {EPS})) / (ln(32) + {EPS})", "spectral_centroid": "any_value(cb)", "spectral_bandwidth": "sqrt(sum(share * pow(k / 31 - cb, 2)))",
    "spec_entropy": f"-sum(share * ln(share + {EPS})) / ln(32)", "spec_centroid": "any_value(cs)", "spec_bandwidth": "any_value(width)",
    "spec_skew": f"sum(share * pow((2 * ks / 31 - 1 - cs) / (width + {EPS}), 3))", "spec_kurtosis": f"sum(share * pow((2 * ks / 31 - 1 - cs) / (width + {EPS}), 4))",
    "spec_flatness": f"exp(avg(ln(pw + {EPS}))) / (avg(pw) + {EPS})", "spec_peak": f"max(pw) / (avg(pw) + {EPS})", "spec_rolloff_90": "coalesce(min(ks) FILTER (upto >= 0.9), 0) / 31",
}
TIME = {**_base(), **_wide(), **_pulse()}

STEPS = f"""
a AS (SELECT id, t, i, q, i * i + q * q AS p, atan2(q, i) AS a0 FROM (SELECT id, unnest(range(32)) AS t, unnest(i) AS i, unnest(q) AS q FROM r)),
b AS (SELECT *, a0 - lag(a0) OVER w AS d, sqrt(p) AS env, sqrt(p + {EPS}) AS amp, lag(i) OVER w AS li, lag(q) OVER w AS lq FROM a WINDOW w AS (PARTITION BY id ORDER BY t)),
ph AS (SELECT *, a0 + sum(CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE -2 * pi() * floor((d + pi()) / (2 * pi())) END) OVER (PARTITION BY id ORDER BY t) AS phase, atan2(q * li - i * lq, i * li + q * lq) AS st FROM b),
tn AS (SELECT *, phase - lag(phase) OVER w AS turn, env - lag(env) OVER w AS edge FROM ph WINDOW w AS (PARTITION BY id ORDER BY t)),
qs AS (SELECT id, {', '.join(f'quantile_cont(env, 0.{n}) AS q{n}' for n in (10, 25, 50, 75, 90, 99))} FROM tn GROUP BY id),
ac AS (SELECT tn.*, q10, q25, q50, q75, q90, q99, env >= q50 + 0.5 * (q90 - q50) AS act FROM tn JOIN qs USING (id)),
ad AS (SELECT *, lag(act) OVER w AS pact, st - lag(st) OVER w AS dr FROM ac WINDOW w AS (PARTITION BY id ORDER BY t)),
ae AS (SELECT *, t > 0 AND act AND pact AS son, t > 1 AND act AND pact AND lag(act AND pact) OVER w AS don FROM ad WINDOW w AS (PARTITION BY id ORDER BY t)),
m AS (SELECT id, avg(amp) AS am, stddev_pop(amp) AS asd, avg(env) AS em, stddev_pop(env) AS esd, avg(phase) AS pm, stddev_pop(phase) AS psd, avg(turn) AS tm, stddev_pop(turn) AS tsd, avg(i) AS im, avg(q) AS qm,
  greatest(count(*) FILTER (son), 1) AS sn, coalesce(sum(st) FILTER (son), 0) / greatest(count(*) FILTER (son), 1) AS sm, greatest(count(*) FILTER (don), 1) AS dn, coalesce(sum(dr) FILTER (don), 0) / greatest(count(*) FILTER (don), 1) AS dm FROM ae GROUP BY id),
ti AS (SELECT id, {', '.join(f'{x} AS {n}' for n, x in TIME.items())} FROM ae JOIN m USING (id) GROUP BY id),
c0 AS (SELECT id, any_value(im) AS im, any_value(qm) AS qm, avg((i - im) * (i - im)) AS ii, avg((q - qm) * (q - qm)) AS qq, avg((i - im) * (q - qm)) AS iq FROM ae JOIN m USING (id) GROUP BY id),
c AS (SELECT *, ii + qq + {EPS} AS total, sqrt(pow(ii - qq, 2) + 4 * iq * iq) AS gap FROM c0),
hw AS (SELECT id, {', '.join(f'{x} AS {n}' for n, x in HARDWARE.items())} FROM c),
ft AS (SELECT id, k, pow(sum(i * cos(2 * pi() * k * t / 32) + q * sin(2 * pi() * k * t / 32)), 2) + pow(sum(q * cos(2 * pi() * k * t / 32) - i * sin(2 * pi() * k * t / 32)), 2) AS pw FROM a, (SELECT unnest(range(32)) AS k) GROUP BY id, k),
s1 AS (SELECT id, k, (k + 16) % 32 AS ks, pw, pw / (sum(pw) OVER (PARTITION BY id) + {EPS}) AS share FROM ft),
s2 AS (SELECT *, sum(share * k / 31) OVER (PARTITION BY id) AS cb, sum(share * (2 * ks / 31 - 1)) OVER (PARTITION BY id) AS cs, sum(share) OVER (PARTITION BY id ORDER BY ks) AS upto FROM s1),
s3 AS (SELECT *, sqrt(sum(share * pow(2 * ks / 31 - 1 - cs, 2)) OVER (PARTITION BY id) + {EPS}) AS width FROM s2),
sp AS (SELECT id, {', '.join(f'{x} AS {n}' for n, x in SPECTRUM.items())} FROM s3 GROUP BY id)"""


def features(names: list[str], digits: int = 5) -> str:
    """A SELECT of id and the named features, rounded, that follows WITH r AS (...), and STEPS."""
    return f"SELECT id, {', '.join(f'round({n}, {digits}) + 0.0 AS {n}' for n in names)} FROM ti JOIN hw USING (id) JOIN sp USING (id)"
