"""Scalar mathematics for three kinds of operands: Python floats, Spark Columns and SQL text.

A formula written with these functions folds to a number on the driver, builds a Column for a DataFrame or becomes text
for a SQL engine. Domain errors are NaN for floats and NULL or NaN elsewhere, never an exception.
"""

from __future__ import annotations

import math
import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def text(v) -> str:
    """A value as SQL text; numbers as doubles."""
    if isinstance(v, Sql):
        return v.sql
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        r = repr(float(v))
        return r if "e" in r else f"{r}e0"
    raise TypeError(type(v))


class Sql:
    """SQL text of an expression, in parentheses where it needs them."""

    __slots__ = ("sql",)
    __hash__ = None

    def __init__(self, sql: str):
        self.sql = sql

    def __add__(self, o):
        return Sql(f"({self.sql} + {text(o)})")

    def __radd__(self, o):
        return Sql(f"({text(o)} + {self.sql})")

    def __sub__(self, o):
        return Sql(f"({self.sql} - {text(o)})")

    def __rsub__(self, o):
        return Sql(f"({text(o)} - {self.sql})")

    def __mul__(self, o):
        return Sql(f"({self.sql} * {text(o)})")

    def __rmul__(self, o):
        return Sql(f"({text(o)} * {self.sql})")

    def __truediv__(self, o):
        return Sql(f"({self.sql} / {text(o)})")

    def __rtruediv__(self, o):
        return Sql(f"({text(o)} / {self.sql})")

    def __neg__(self):
        return Sql(f"(-{self.sql})")

    def __lt__(self, o):
        return Sql(f"({self.sql} < {text(o)})")

    def __le__(self, o):
        return Sql(f"({self.sql} <= {text(o)})")

    def __gt__(self, o):
        return Sql(f"({self.sql} > {text(o)})")

    def __ge__(self, o):
        return Sql(f"({self.sql} >= {text(o)})")

    def __eq__(self, o):
        return Sql(f"({self.sql} = {text(o)})")

    def __ne__(self, o):
        return Sql(f"({self.sql} <> {text(o)})")


def _kind(*args):
    if any(isinstance(a, Column) for a in args):
        return Column
    return Sql if any(isinstance(a, Sql) for a in args) else float


def _call(name: str, float_fn, *args, column=None, sql: str | None = None):
    kind = _kind(*args)
    if kind is Column:
        return (column or getattr(F, name))(*(a if isinstance(a, Column) else F.lit(float(a)) for a in args))
    if kind is Sql:
        return Sql(f"{sql or name}({', '.join(map(text, args))})")
    try:
        return float_fn(*args)
    except (ValueError, OverflowError, ZeroDivisionError):
        return math.nan


def _guarded(x, inside, name, float_fn):
    """A function with a limited domain: NULL outside it (NaN for floats), whatever the engine does there."""
    kind = _kind(x)
    if kind is Column:
        return F.when(inside(x), getattr(F, name)(x))
    if kind is Sql:
        return Sql(f"(CASE WHEN {inside(x).sql} THEN {name}({x.sql}) END)")
    return _call(name, float_fn, x)


def sin(x):
    return _call("sin", math.sin, x)


def cos(x):
    return _call("cos", math.cos, x)


def tan(x):
    return _call("tan", math.tan, x)


def atan(x):
    return _call("atan", math.atan, x)


def atan2(y, x):
    return _call("atan2", math.atan2, y, x)


def exp(x):
    return _call("exp", math.exp, x)


def ln(x):
    return _guarded(x, lambda v: v > 0, "ln", math.log)


def sqrt(x):
    return _guarded(x, lambda v: v >= 0, "sqrt", math.sqrt)


def asin(x):
    return _guarded(x, lambda v: both(v >= -1, v <= 1), "asin", math.asin)


def acos(x):
    return _guarded(x, lambda v: both(v >= -1, v <= 1), "acos", math.acos)


def power(x, p):
    return _call("pow", math.pow, x, p, column=F.pow)


def absolute(x):
    return _call("abs", abs, x)


def floor(x):
    """The largest whole number below, as a double."""
    if isinstance(x, Column):
        return F.floor(x).cast("double")
    return _call("floor", lambda v: float(math.floor(v)), x)


def ceil(x):
    if isinstance(x, Column):
        return F.ceil(x).cast("double")
    return _call("ceil", lambda v: float(math.ceil(v)), x)


def trunc(x):
    """Toward zero, as a double."""
    return where(x < 0, ceil(x), floor(x))


def nint(x):
    """Half up by truncation of x + 0.5, so negatives round toward zero."""
    return trunc(x + 0.5)


def div(a, b):
    """a / b, missing where b is 0."""
    kind = _kind(a, b)
    if kind is Column:
        return F.try_divide(a if isinstance(a, Column) else F.lit(float(a)), b if isinstance(b, Column) else F.lit(float(b)))
    if kind is Sql:
        return Sql(f"({text(a)} / nullif({text(b)}, 0e0))")
    return a / b if b else math.nan


def where(cond, a, b):
    """a where cond holds, else b (None: missing). A missing condition counts as false."""
    kind = _kind(cond, a, b)
    if kind is Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(None).cast("double") if v is None else F.lit(v if isinstance(v, bool) else float(v))
        return F.when(cond if isinstance(cond, Column) else F.lit(cond), lit(a)).otherwise(lit(b))
    if kind is Sql:
        return Sql(f"(CASE WHEN {text(cond)} THEN {text(a)} ELSE {text(b)} END)")
    out = a if cond else b
    return math.nan if out is None else out


def both(a, b):
    kind = _kind(a, b)
    if kind is Column:
        return (a if isinstance(a, Column) else F.lit(a)) & (b if isinstance(b, Column) else F.lit(b))
    return Sql(f"({text(a)} AND {text(b)})") if kind is Sql else bool(a and b)


def either(a, b):
    kind = _kind(a, b)
    if kind is Column:
        return (a if isinstance(a, Column) else F.lit(a)) | (b if isinstance(b, Column) else F.lit(b))
    return Sql(f"({text(a)} OR {text(b)})") if kind is Sql else bool(a or b)


def finite(x):
    """Whether a number is there: not missing, not NaN, not infinite."""
    if isinstance(x, Column):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e300))
    if isinstance(x, Sql):
        return Sql(f"(coalesce(abs({x.sql}) < 1e300, FALSE))")
    return math.isfinite(x)


def radians(t):
    return t * PI / 180.0


def degrees(t):
    return t * 180.0 / PI


def sign(x):
    """-1 below 0, else 1."""
    return where(x < 0, -1.0, 1.0)


def clamp(x):
    """Within -1 and 1."""
    return where(x > 1, 1.0, where(x < -1, -1.0, x))


def asinz(x):
    """asin of the clamped argument."""
    return _call("asin", math.asin, clamp(x))


def normal_lon(x):
    """A longitude in degrees brought to -180 to 180, both inclusive."""
    return where(x > 180, x - 360.0 * ceil((x - 180.0) / 360.0), where(x < -180, x + 360.0 * ceil((-180.0 - x) / 360.0), x))


def normal_rad(x):
    return where(x > PI, x - 2 * PI * ceil((x - PI) / (2 * PI)), where(x < -PI, x + 2 * PI * ceil((-PI - x) / (2 * PI)), x))


def double(high: int) -> float:
    """The double whose high word this is; its low word is 0."""
    return struct.unpack(">d", struct.pack(">q", high << 32))[0]


#: pi in two parts, the first of 33 bits: a product of it and a small whole number is exact.
PI_1, PI_2 = 3.14159265346825122833e00, 1.21542010130121322891e-10
#: sin(r) = r + r^3 (S0 + r^2 (S1 + ..)) up to pi / 2: its Taylor series.
SINE = tuple((-1.0) ** k / math.factorial(2 * k + 1) for k in range(1, 12))
#: fdlibm's coefficients, which Java's StrictMath is defined by.
ATAN = (
    3.33333333333329318027e-01, -1.99999999998764832476e-01, 1.42857142725034663711e-01, -1.11111104054623557880e-01, 9.09088713343650656196e-02, -7.69187620504482999495e-02,
    6.66107313738753120669e-02, -5.83357013379057348645e-02, 4.97687799461593236017e-02, -3.65315727442169155270e-02, 1.62858201153657823623e-02,
)
ATAN_HIGH = (4.63647609000806093515e-01, 7.85398163397448278999e-01, 9.82793723247329054082e-01, 1.57079632679489655800e00)
ATAN_LOW = (2.26987774529616870924e-17, 3.06161699786838301793e-17, 1.39033110312309984516e-17, 6.12323399573676603587e-17)
PI_LOW = 1.2246467991473531772e-16
LN2_HIGH, LN2_LOW, PER_LN2 = 6.93147180369123816490e-01, 1.90821492927058770002e-10, 1.44269504088896338700e00
EXP = (1.66666666666666019037e-01, -2.77777777770155933842e-03, 6.61375632143793436117e-05, -1.65339022054652515390e-06, 4.13813679705723846039e-08)
LOG = (6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01, 1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01)


def horner(x, coefficients):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = c + x * out
    return out


class Functions:
    """Elementary functions that have one result whatever the engine, to the last bit. Libraries round sines differently, and a
    rounded result shows it. On Columns and SQL text alike sines and cosines are arithmetic written out; others are what StrictMath
    (by definition fdlibm) gives to Columns, and fdlibm's own arithmetic in SQL. asin, acos and powers come of these. Floats take math's."""

    def _once(self, name: str, x, make):
        """What make(x) gives, one step for all uses of the function at x (of a Column's sine the step before the last)."""
        if _kind(x) is float:
            return globals()[name](x)
        key = (name, x.sql if isinstance(x, Sql) else str(x))
        if key not in self.known:
            made = make(x if re.fullmatch(r"\w+|Column<'\w+'>", key[1]) else self.let(x))
            self.known[key] = made if name in ("sin", "cos") and isinstance(made, Column) else self.let(made)
        return self.known[key]

    def _sine(self, x, half: float):
        """sin(x), or with a half cos(x): a sine of what is left of x by whole multiples of pi, and half of it."""
        if isinstance(x, Column):  # as text: a call for each operation would take its time
            x = Sql(re.findall(r"\w+", str(x))[1])
            whole, made = (lambda v: Sql(f"CAST(floor({v.sql}) AS DOUBLE)")), lambda v: F.expr(v.sql)
        else:
            whole, made = floor, lambda v: v
        n = whole(x * (1 / PI) + (0.5 + half))
        m = n - half if half else n
        r = self.let(made(((x - m * PI_1) - m * PI_2) * (1.0 - 2.0 * (n - 2.0 * whole(n * 0.5)))))
        r = r if isinstance(r, Sql) else Sql(re.findall(r"\w+", str(r))[1])
        z = r * r
        return made(r + r * z * horner(z, SINE))

    def sin(self, x):
        return self._once("sin", x, lambda v: self._sine(v, 0.0))

    def cos(self, x):
        return self._once("cos", x, lambda v: self._sine(v, 0.5))

    def tan(self, x):
        return tan(x) if _kind(x) is float else div(self.sin(x), self.cos(x))

    def atan(self, x):
        return self._once("atan", x, lambda v: atan(v) if isinstance(v, Column) else self._atan(v))

    def _atan(self, x):
        a = self.let(absolute(x))
        small, low, middle, high = a < 0.4375, a < 0.6875, a < 1.1875, a < 2.4375
        pick = lambda c: where(low, c[0], where(middle, c[1], where(high, c[2], c[3])))
        r = self.let(where(small, a, where(low, (2.0 * a - 1.0) / (2.0 + a), where(middle, (a - 1.0) / (a + 1.0), where(high, (a - 1.5) / (1.0 + 1.5 * a), -1.0 / a)))))
        w = (z := r * r) * z
        p = self.let(r * (z * horner(w, ATAN[::2]) + w * horner(w, ATAN[1::2])))
        out = where(small, r - p, pick(ATAN_HIGH) - ((p - pick(ATAN_LOW)) - r))
        return where(x < 0, -self.let(out), out)

    def atan2(self, y, x):
        kind = _kind(y, x)
        if kind is not Sql:
            return atan2(y, x)
        y, x = (v if isinstance(v, Sql) else Sql(text(v)) for v in (y, x))
        y, x = self.let(y), self.let(x)
        z = self._atan(self.let(absolute(div(y, x))))
        z = self.let(where(x == 0, PI / 2, z))
        z = self.let(where(x < 0, PI - (z - PI_LOW), z))
        return where(y == 0, where(x < 0, PI, 0.0), where(y < 0, where(x < 0, -z, -z), z))

    def asin(self, x):
        return self._once("asin", x, lambda v: self._of_ratio(v, lambda c: self.atan2(v, c)))

    def acos(self, x):
        return self._once("acos", x, lambda v: self._of_ratio(v, lambda c: self.atan2(c, v)))

    def asinz(self, x):
        return self.asin(clamp(self.part(x)))

    def part(self, x):
        """x, of a Column a step of its own: a long formula that the next one names several times."""
        return x

    def _of_ratio(self, x, make):
        return where(both(x >= -1, x <= 1), make(self.let(sqrt((1.0 - x) * (1.0 + x)))), None)

    def exp(self, x):
        return self._once("exp", x, lambda v: exp(v) if isinstance(v, Column) else self._exp(v))

    def _exp(self, x):
        side = where(x < 0, -1.0, 1.0)
        k = self.let(where(absolute(x) < double(0x3FD62E43), 0.0, where(absolute(x) < double(0x3FF0A2B2), side, trunc(PER_LN2 * x + 0.5 * side))))
        high, low = self.let(x - k * LN2_HIGH), self.let(k * LN2_LOW)
        r = self.let(high - low)
        t = r * r
        c = self.let(r - t * horner(t, EXP))
        return where(absolute(x) < 2.0**-28, 1.0 + x, (1.0 - ((low - (r * c) / (2.0 - c)) - high)) * power(2.0, k))

    def ln(self, x):
        return self._once("ln", x, lambda v: ln(v) if isinstance(v, Column) else self._ln(v))

    def _ln(self, x):
        k = self.let(Sql(f"(CASE WHEN {x.sql} > 0e0 AND {x.sql} < 1e300 THEN floor(log2({x.sql})) END)"))  # a guess, set right next
        m = self.let(x / power(2.0, k))
        k = self.let(where(m >= 2, k + 1.0, where(m < 1, k - 1.0, k)))
        m = self.let(x / power(2.0, k))
        above = m >= double(0x3FF6A09C)
        f, k = self.let(where(above, m * 0.5, m) - 1.0), self.let(where(above, k + 1.0, k))
        s = self.let(f / (2.0 + f))
        w = (z := s * s) * z
        r = self.let(z * horner(w, LOG[::2]) + w * horner(w, LOG[1::2]))
        near = f * f * (0.5 - 0.33333333333333333 * f)
        h = 0.5 * f * f
        rest = where(
            both(f >= -(2.0**-20), f < 2.0**-20),
            near - k * LN2_LOW,
            where(both(m >= double(0x3FF6147A), m < double(0x3FF6B852)), h - (s * (h + r) + k * LN2_LOW), s * (f - r) - k * LN2_LOW),
        )
        return k * LN2_HIGH - (rest - f)

    def power(self, x, p: float):
        """x ** p for a fixed p: missing below 0."""
        if _kind(x) is float:
            return power(x, p)
        x = self.let(x)
        return where(x > 0, self.exp(p * self.ln(x)), where(x == 0, 1.0 if p == 0 else 0.0 if p > 0 else None, None))


class Now(Functions):
    """Steps of a formula on floats: a step is its value."""

    def let(self, x):
        return x


#: Characters of formulas in one generated method, about: the JVM compiles methods of up to 8,000 bytes of code only, and interprets
#: longer ones.
SPAN = 1200


def apart(c: Column) -> Column:
    """A column as it is, by a function over arrays: Spark generates no joint method across it, so the method before it ends here.
    It is named twice, as else its formula would be moved in here and interpreted."""
    return F.get(F.transform(F.array(c, c), lambda v: v), 0)


class Steps(Functions):
    """Steps of a formula on a DataFrame: each is a column, so that later steps refer to it instead of repeating it. Steps that
    don't need each other are made in one projection; every SPAN characters a generated method ends."""

    def __init__(self, df, prefix: str = "_s"):
        self.given, self.prefix, self.known = df, prefix, {}
        self.taken, self.depth, self.layers = set(df.columns), {}, []

    def let(self, x):
        if not isinstance(x, Column):
            return x
        used = str(x)
        n = len(self.depth) + 1
        while f"{self.prefix}{n}" in self.taken:
            n += 1
        name = f"{self.prefix}{n}"
        self.taken.add(name)
        at = self.depth[name] = 1 + max((self.depth.get(w, 0) for w in re.findall(r"\w+", used)), default=0)
        if at > len(self.layers):
            self.layers.append({})
        self.layers[at - 1][name] = (x, len(used))
        return F.col(name)

    part = let

    @property
    def df(self):
        out, long = self.given, 0
        for layer in self.layers:
            out = out.withColumns({name: x for name, (x, _) in layer.items()})
            long += sum(n for _, n in layer.values())
            if long > SPAN:
                out, long = out.withColumn(name := next(iter(layer)), apart(F.col(name))), 0
        return out


class Ctes(Functions):
    """Steps of a formula as common table expressions over a relation; table() names the last one."""

    def __init__(self, relation: str, ctes: list[str] | None = None):
        self.last, self.ctes, self.known = relation, [] if ctes is None else ctes, {}

    def let(self, x):
        if not isinstance(x, Sql) or x.sql.isidentifier():
            return x
        name = f"_s{len(self.ctes)}"
        self.ctes.append(f"{name}_t AS (SELECT *, {x.sql} AS {name} FROM {self.last})")
        self.last = f"{name}_t"
        return Sql(name)

    def query(self, select: str) -> str:
        return ("WITH " + ",\n".join(self.ctes) + "\n" if self.ctes else "") + f"SELECT {select} FROM {self.last}"
