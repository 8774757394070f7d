"""Tails and quantiles of the t, F and normal distributions as column expressions.

Both the two-sided t test and the F test are one regularised incomplete beta
function I_x(a, b). Its continued fraction (modified Lentz form, as in any numerical
handbook) runs inside ``aggregate`` over a constant sequence and stops doing work
once it has converged, typically within 10 to 50 steps. Arguments and results are
SQL fragments, so an expression of any size is parsed once and stays in the JVM.
"""

from __future__ import annotations

import math

from .safe import let

_FIRST_STEPS = 64
_MAX_STEPS = 4000
_EPS = "1e-15D"

# Lanczos coefficients for g = 7, nine terms (published fixed values).
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028,
    771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]


def _num(v: float) -> str:
    return f"{v!r}D"


def ln_gamma(x: str) -> str:
    """log Gamma(x) for x >= 0.5."""
    series = _num(_LANCZOS[0]) + "".join(
        f" + {_num(c)} / (lg + {i}.0D)" for i, c in enumerate(_LANCZOS[1:], start=1)
    )
    value = f"0.9189385332046727D + (lg + 0.5D) * ln(lg + 7.5D) - (lg + 7.5D) + ln({series})"
    return let("lg", f"({x}) - 1.0D", value)


def _stirling_rest(z: str) -> str:
    return f"(1.0D / (12.0D * {z}) - 1.0D / (360.0D * power({z}, 3)) + 1.0D / (1260.0D * power({z}, 5)))"


def _stirling_gap(big: str, small: str) -> str:
    """log Gamma(big + small) - log Gamma(big), without cancellation for large ``big``."""
    return (f"({big} - 0.5D) * log1p({small} / {big}) + {small} * ln({big} + {small}) - {small}"
            f" + {_stirling_rest(f'({big} + {small})')} - {_stirling_rest(big)}")


def neg_ln_beta(a: str, b: str) -> str:
    """-log B(a, b). Stirling differences keep the digits when one side is large."""
    big, small = "nb.hi", "nb.lo"
    gap = (f"case when {big} >= 20 then {_stirling_gap(big, small)}"
           f" else {ln_gamma(f'{big} + {small}')} - {ln_gamma(big)} end")
    body = f"{gap} - {ln_gamma(small)}"
    return let("nb", f"named_struct('hi', greatest({a}, {b}), 'lo', least({a}, {b}))", body)


def neg_ln_beta_half(a: str) -> str:
    """-log B(a, 1/2), the constant of the t distribution."""
    gap = (f"case when nb >= 20 then {_stirling_gap('nb', '0.5D')}"
           f" else {ln_gamma('nb + 0.5D')} - {ln_gamma('nb')} end")
    return let("nb", a, f"{gap} - {_num(math.log(math.pi) / 2)}")


def _beta_fraction(a: str, b: str, x: str) -> str:
    """Continued fraction of I_x(a, b), good for x < (a+1)/(a+b+2).

    Adding 1e-300 keeps a zero denominator apart from zero and changes nothing else.
    """
    def half(state: str, term: str, name: str) -> str:
        cd = (f"named_struct('c', 1.0D + {term} / {state}.c + 1e-300D,"
              f" 'd', 1.0D / (1.0D + {term} * {state}.d + 1e-300D))")
        grown = (f"named_struct('c', {name}.c, 'd', {name}.d, 'h', {state}.h * {name}.c * {name}.d,"
                 f" 'done', abs({name}.c * {name}.d - 1.0D) < {_EPS})")
        return let(name, cd, grown)

    even = f"(m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m)))"
    odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
    step = let("mid", half("s", even, "e1"), half("mid", odd, "o1"))
    d0 = f"1.0D / (1.0D - ({a} + {b}) * {x} / ({a} + 1.0D) + 1e-300D)"
    start = "named_struct('c', 1.0D, 'd', d0, 'h', d0, 'done', false)"
    # Most rows end in the short first loop; only the others enter the long one.
    first = f"aggregate(sequence(1, {_FIRST_STEPS}), {start}, (s, m) -> case when s.done then s else {step} end)"
    rest = (f"aggregate(sequence({_FIRST_STEPS + 1}, {_MAX_STEPS}), fs, (s, m) -> case when s.done then s else {step} end,"
            " s -> case when s.done then s.h else cast(raise_error('incomplete beta did not converge') as double) end)")
    ended = f"case when fs.done or fs.h is null or isnan(fs.h) then fs.h else {rest} end"
    return let("d0", d0, let("fs", first, ended))


def beta_inc(a: str, b: str, x: str, x1: str, const: str | None = None) -> str:
    """I_x(a, b); ``x1`` is 1 - x, passed in so that no digits are lost.

    ``const`` is -log B(a, b) where the caller has it already.
    """
    part = (f"exp(bt.k + bt.a * ln(bt.x) + bt.b * ln(bt.y)) * {_beta_fraction('bt.a', 'bt.b', 'bt.x')} / bt.a")
    chosen = (
        "case when bi.turn then named_struct('a', bi.b, 'b', bi.a, 'x', bi.y, 'y', bi.x, 'k', bi.k)"
        " else named_struct('a', bi.a, 'b', bi.b, 'x', bi.x, 'y', bi.y, 'k', bi.k) end"
    )
    inside = let("pt", let("bt", chosen, part), "case when bi.turn then 1.0D - pt else pt end")
    body = f"case when bi.x <= 0 then 0.0D when bi.y <= 0 then 1.0D else {inside} end"
    args = (
        f"named_struct('a', {a}, 'b', {b}, 'x', {x}, 'y', {x1}, 'k', {const or neg_ln_beta(a, b)},"
        f" 'turn', {x} >= ({a} + 1) / ({a} + {b} + 2))"
    )
    return let("bi", args, body)


def _t_tail(t: str, nu: str, const: str) -> str:
    """Two-sided tail for bound variables and a known constant."""
    return beta_inc(f"({nu} / 2)", "0.5D", f"({nu} / ({nu} + {t} * {t}))", f"({t} * {t} / ({nu} + {t} * {t}))", const)


def t_two_sided(t: str, df: str) -> str:
    """Two-sided p-value of a t statistic: P(|T| >= |t|); NULL when df < 1 or t is NULL."""
    args = f"named_struct('v', cast({df} as double), 't', cast({t} as double))"
    tail = let("tt", args, _t_tail("tt.t", "tt.v", neg_ln_beta_half("tt.v / 2")))
    return f"case when {df} > 0 and {t} is not null then {tail} end"


def f_sf(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution: P(F' >= f)."""
    args = (f"named_struct('f', cast({f} as double), 'm', cast({d1} as double),"
            f" 'n', cast({d2} as double))")
    total = "(ft.n + ft.m * ft.f)"
    tail = let("ft", args, beta_inc("(ft.n / 2)", "(ft.m / 2)", f"(ft.n / {total})",
                                    f"(ft.m * ft.f / {total})"))
    return f"case when {d1} > 0 and {d2} > 0 and {f} is not null then {tail} end"


# Wichura's algorithm AS 241 (PPND16): published fixed coefficients, low order first.
AS241_A = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
AS241_B = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
AS241_C = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
AS241_D = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
AS241_E = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
AS241_F = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]



def _poly(coef: list[float], x: str) -> str:
    out = _num(coef[-1])
    for c in reversed(coef[:-1]):
        out = f"({out} * {x} + {_num(c)})"
    return out


def norm_upper_ppf(tail: str) -> str:
    """z with P(Z > z) = tail, for 0 < tail <= 0.5 (no cancellation in 1 - tail)."""
    centre = let("nq", f"0.5D - ({tail})", let(
        "nr", "0.180625D - nq * nq", f"nq * {_poly(AS241_A, 'nr')} / {_poly(AS241_B, 'nr')}"))
    near = let("ns", "nr - 1.6D", f"{_poly(AS241_C, 'ns')} / {_poly(AS241_D, 'ns')}")
    far = let("ns", "nr - 5.0D", f"{_poly(AS241_E, 'ns')} / {_poly(AS241_F, 'ns')}")
    outer = let("nr", f"sqrt(-ln({tail}))", f"case when nr <= 5 then {near} else {far} end")
    return f"case when {tail} >= 0.075D then {centre} when {tail} > 0 then {outer} end"


def norm_ppf(p: str) -> str:
    """Quantile of the standard normal distribution; NULL outside (0, 1)."""
    upper = norm_upper_ppf(f"(1.0D - ({p}))")
    lower = norm_upper_ppf(f"({p})")
    return (f"case when {p} >= 0.5D and {p} < 1 then {upper}"
            f" when {p} > 0 and {p} < 0.5D then -({lower}) end")


def _norm_upper(tail: float) -> float:
    """The same quantile for one constant, by bisection on erfc."""
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if math.erfc(mid / math.sqrt(2)) / 2 > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_upper_ppf(tail: float, df: str) -> str:
    """t with P(T > t) = tail for a constant 0 < tail < 0.5 and a column of df >= 1.

    Starts from the Cornish-Fisher expansion and takes Newton steps on the tail. For many degrees of freedom the expansion itself
    is exact to rounding, whereas the tail loses a digit for each digit of df, so that steps would never get small.
    """
    if not 0.0 < tail < 0.5:
        raise ValueError("tail must lie in (0, 0.5)")
    z = _norm_upper(tail)
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    first = _poly(terms, "(1.0D / tq)")
    left_out = abs(27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640
    many = max(10_000.0, (left_out / (1e-15 * z)) ** 0.2)  # from here on the next term is below rounding
    density = "exp(tb - 0.5D * ln(tq) - (tq + 1) / 2 * log1p(ts.t * ts.t / tq))"
    move = f"({_t_tail('ts.t', 'tq', 'tb')} / 2 - {_num(tail)}) / {density}"
    after = let("mv", move, "named_struct('t', ts.t + mv, 'done', abs(mv) < 1e-12D * (1 + ts.t))")
    loop = (f"aggregate(sequence(1, 40), named_struct('t', {first}, 'done', false),"
            f" (ts, i) -> case when ts.done then ts else {after} end,"
            " ts -> case when ts.done then ts.t else cast(raise_error('the t quantile did not converge') as double) end)")
    solved = let("tb", neg_ln_beta_half("tq / 2"), loop)
    one = _num(1 / math.tan(math.pi * tail))
    two = _num((1 - 2 * tail) * math.sqrt(2 / (4 * tail * (1 - tail))))
    body = f"case when tq = 1 then {one} when tq = 2 then {two} when tq >= {_num(many)} then {first} else {solved} end"
    return f"case when {df} > 0 then {let('tq', f'cast({df} as double)', body)} end"
