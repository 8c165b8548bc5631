"""Image kernels as SQL expressions over packed rasters: a column v array<int> in row order, with columns h and w.

Every kernel works within its row, so no kernel shuffles. In the templates, i is a pixel's place, y and x its row and
column. These are meant for tiles and thumbnails; lumagrid.operators.kernels holds the same kernels over numpy blocks
for large images.
"""

from __future__ import annotations

Y, X = "cast(i div w as int)", "cast(i % w as int)"
#: Cosines and sines of 0 to 90 degrees in steps of 15, in thousandths.
HOUGH = [(0, 1000, 0), (15, 966, 259), (30, 866, 500), (45, 707, 707), (60, 500, 866), (75, 259, 966), (90, 0, 1000)]


def every(expression: str) -> str:
    """An array with the expression for each pixel."""
    return f"transform(sequence(0, h * w - 1), i -> {expression})"


def near(dy: int, dx: int, v: str = "v") -> str:
    """The neighbour's value; the border repeats."""
    return f"{v}[greatest(0, least(h - 1, {Y} + {dy})) * w + greatest(0, least(w - 1, {X} + {dx}))]"


def inside(dy: int, dx: int, otherwise: str = "null", v: str = "v") -> str:
    """The neighbour's value, or another one beyond the border."""
    return f"case when {Y} + {dy} between 0 and h - 1 and {X} + {dx} between 0 and w - 1 then {v}[({Y} + {dy}) * w + {X} + {dx}] else {otherwise} end"


AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
BOX3 = every(f"cast(floor(({' + '.join(near(*d) for d in AROUND)}) / 9.0D) as int)")
BOX3_SUM = every(" + ".join(inside(*d, otherwise="0") for d in AROUND))


def running(array: str, chunk: int = 64) -> str:
    """Running sums of an array: within chunks, and then over the chunks' totals, so that no array grows by one at a time for long."""
    own = f"slice(aggregate(slice(x_, k * {chunk} + 1, {chunk}), array(0L), (s, p) -> array_append(s, element_at(s, -1) + p)), 2, {chunk})"
    before = "aggregate(c_, array(0L), (s, c) -> array_append(s, element_at(s, -1) + element_at(c, -1)))"
    added = "flatten(transform(c_, (c, k) -> transform(c, p -> p + o_[k])))"
    return f"transform(array({array}), x_ -> transform(array(transform(sequence(0, cast((size(x_) - 1) div {chunk} as int)), k -> {own})), c_ -> transform(array({before}), o_ -> {added})[0])[0])[0]"


#: Running sums of each row, which are then added up from row to row.
ROWS_SUMMED = f"transform(sequence(0, h - 1), y -> {running('slice(v, y * w + 1, w)')})"
INTEGRAL = "flatten(aggregate(r_, struct(cast(array() as array<array<bigint>>) as done, array_repeat(0L, w) as last), (s, r) -> transform(array(zip_with(s.last, r, (a, b) -> a + b)), n -> struct(array_append(s.done, n) as done, n as last))[0]).done)"
MEDIAN3 = every(f"transform(array(array_sort(filter(array({', '.join(inside(*d) for d in AROUND)}), p -> p is not null))), s -> (s[cast(floor((size(s) - 1) / 2D) as int)] + s[cast(floor(size(s) / 2D) as int)]) / 2D)[0]")
ERODED = every(f"least({inside(0, -1, 'v[i]')}, v[i], {inside(0, 1, 'v[i]')})")
DILATED = every(f"greatest({inside(0, -1, 'e_[i]', 'e_')}, e_[i], {inside(0, 1, 'e_[i]', 'e_')})")
LAPLACIAN = f"transform(filter(sequence(0, h * w - 1), i -> {Y} between 1 and h - 2 and {X} between 1 and w - 2), i -> cast(4 * v[i] - v[i - 1] - v[i + 1] - v[i - w] - v[i + w] as bigint))"
UNSHARP = every("greatest(0, least(255, 2 * v[i] - b_[i]))")
GAMMA_SQRT = "transform(v, p -> cast(floor(sqrt(p * 255.0D)) as int))"
STRETCH = "transform(v, p -> case when m_[1] > m_[0] then cast(floor((p - m_[0]) * 255.0D / (m_[1] - m_[0])) as int) end)"
ENDS = "array(array_min(v), array_max(v))"
#: With the histogram as h_: how many pixels are up to each of its values; pixels look their value up among the distinct ones.
UP_TO = running("transform(h_, e -> cast(e.n as bigint))")
HIST_EQ = "transform(array(transform(h_, e -> e.v)), d_ -> transform(array(transform(u_, c -> cast(floor(255.0D * (c - u_[0]) / greatest(1, h * w - u_[0])) as int))), l_ -> transform(v, p -> l_[array_position(d_, p) - 1]))[0])[0]"
DOWNSAMPLE2 = f"transform(sequence(0, (h div 2) * (w div 2) - 1), i -> cast(floor((v[2 * (i div (w div 2)) * w + 2 * (i % (w div 2))] + v[2 * (i div (w div 2)) * w + 2 * (i % (w div 2)) + 1] + v[(2 * (i div (w div 2)) + 1) * w + 2 * (i % (w div 2))] + v[(2 * (i div (w div 2)) + 1) * w + 2 * (i % (w div 2)) + 1]) / 4D) as int))"
ROT90 = "transform(sequence(0, h * w - 1), i -> v[(h - 1 - i % h) * w + i div h])"
RUN_STARTS = f"filter(sequence(0, h * w - 1), i -> v[i] > {{t}} and ({X} = 0 or v[i - 1] <= {{t}}))"
RUN_ENDS = f"filter(sequence(0, h * w - 1), i -> v[i] > {{t}} and ({X} = w - 1 or v[i + 1] <= {{t}}))"
EDGES = "flatten(transform(filter(sequence(0, h * w - 1), i -> v[i] > {t}), i -> filter(array(" + ", ".join(f"named_struct('y', {Y}, 'x', {X}, 'dir', '{name}', 'n', {inside(dy, dx, '-1')})" for name, dy, dx in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))) + "), e -> e.n <= {t})))"


def moment(p: int, q: int) -> str:
    """Sum of x^p y^q v."""
    return f"aggregate(sequence(0, h * w - 1), 0L, (s, i) -> s + {' * '.join(['cast(v[i] as bigint)', *[X] * p, *[Y] * q])})"


def nearest(centres: tuple[int, ...]) -> str:
    """Index of the nearest centre of each pixel; ties go to the lowest."""
    return "transform(v, p -> array_min(array(" + ", ".join(f"struct(abs(p - {c}) as d, {k} as k)" for k, c in enumerate(centres)) + ")).k)"


def window(fold: str, radius: int, v: str = "v") -> str:
    """greatest, least or sum of the square around each pixel; the border repeats.

    The raster is padded once; then each row and after that each column is folded by plain steps along the padded array,
    whose last places of a row, which mix two rows, are cut off.
    """
    d, n = 2 * radius, f"(w + {2 * radius})"
    padded = f"transform(sequence(0, (h + {d}) * {n} - 1), i -> {v}[greatest(0, least(h - 1, cast(i div {n} as int) - {radius})) * w + greatest(0, least(w - 1, i % {n} - {radius}))])"
    fold_ = lambda parts: " + ".join(parts) if fold == "sum" else f"{fold}({', '.join(parts)})"
    across = f"transform(sequence(0, size(p0_) - {d + 1}), i -> {fold_([f'p0_[i + {k}]' for k in range(d + 1)])})"
    down = f"transform(sequence(0, h * {n} - {d + 1}), i -> {fold_([f'p1_[i + {k} * {n}]' for k in range(d + 1)])})"
    cut = f"flatten(transform(sequence(0, h - 1), y -> slice(p2_, y * {n} + 1, w)))"
    return f"transform(array({padded}), p0_ -> transform(array({across}), p1_ -> transform(array({down}), p2_ -> {cut})[0])[0])[0]"


def paper(radius: int, v: str = "c_") -> str:
    """The mean of a square of the closed raster, 1 at least."""
    return f"transform({window('sum', radius, v)}, p -> greatest(p / {(2 * radius + 1) ** 2}.0D, 1D))"


def brightened(v: str = "v", paper_: str = "p_") -> str:
    """Each pixel over its paper, times the brightest paper."""
    return f"transform(array(array_max({paper_})), hi_ -> transform({v}, (p, i) -> cast(greatest(0D, least(255D, rint(p * (hi_ / {paper_}[i])))) as int)))[0]"


def histogram(v: str = "v") -> str:
    """Distinct values with their counts, for folds over an image that do not depend on its size: runs of the sorted values."""
    starts = "filter(sequence(0, greatest(0, size(s_) - 1)), i -> i < size(s_) and (i = 0 or s_[i] != s_[i - 1]))"
    runs = "transform(a_, (a, j) -> struct(s_[a] as v, if(j + 1 < size(a_), a_[j + 1], size(s_)) - a as n))"
    return f"transform(array(sort_array({v})), s_ -> transform(array({starts}), a_ -> {runs})[0])[0]"


def lloyd(k: int, steps: int) -> str:
    """Centres of k-means over the histogram h_, from k even places between the least and the greatest value.

    Classes are intervals of the histogram, so a step finds their k - 1 borders and takes counts and sums from running totals.
    """
    low, span = "h_[0].v", "(h_[size(h_) - 1].v - h_[0].v)"
    first = "array(" + ", ".join(f"{low} + {2 * i + 1} * {span} / {2 * k}.0D" for i in range(k)) + ")"
    totals = "aggregate(h_, struct(array(0L) as n, array(0L) as s), (t, e) -> struct(concat(t.n, array(element_at(t.n, -1) + e.n)) as n, concat(t.s, array(element_at(t.s, -1) + cast(e.v as bigint) * e.n)) as s))"
    borders = ["0", *[f"size(filter(h_, e -> abs(e.v - c[{j}]) <= abs(e.v - c[{j + 1}])))" for j in range(k - 1)]]
    ends = "array(" + ", ".join(["0", *[f"greatest({', '.join(borders[: j + 1])})" for j in range(1, k)], "size(h_)"]) + ")"
    step = f"transform(array({ends}), q_ -> transform(c, (m, j) -> coalesce((u_.s[q_[j + 1]] - u_.s[q_[j]]) / nullif(u_.n[q_[j + 1]] - u_.n[q_[j]], 0L), m)))[0]"
    return f"transform(array({totals}), u_ -> aggregate(sequence(1, {steps}), {first}, (c, t) -> {step}))[0]"


def classed(k: int, centres: str = "c_") -> str:
    """Index of the nearest of the k rising centres of each pixel; ties go to the lowest. Classes are intervals, so the histogram h_ tells where each begins."""
    own = f"array_min(transform({centres}, (m, j) -> struct(abs(e.v - m) as d, j as j))).j"
    starts = "array(" + ", ".join(f"aggregate(k_, cast(null as int), (s, e) -> if(s is null and e.j >= {j}, e.v, s))" for j in range(1, k)) + ")"
    count = " + ".join(f"if(p >= b_[{j}], 1, 0)" for j in range(k - 1)) or "0"
    return f"transform(array(transform(h_, e -> struct(e.v as v, {own} as j))), k_ -> transform(array({starts}), b_ -> transform(v, p -> if(p is null, null, {count})))[0])[0]"


def otsu() -> str:
    """Otsu's threshold from the histogram h_: the least value that maximises the variance between the classes."""
    whole = "aggregate(h_, struct(0L as w, 0L as s), (t, e) -> struct(t.w + e.n as w, t.s + cast(e.v as bigint) * e.n as s))"
    d = "(cast(t_.s as double) * (b.w + e.n) - cast(t_.w as double) * (b.s + cast(e.v as bigint) * e.n))"
    between = f"case when b.w + e.n < t_.w then {d} * {d} / (cast(b.w + e.n as double) * (t_.w - b.w - e.n)) else 0D end"
    step = f"transform(array({between}), z -> struct(b.w + e.n as w, b.s + cast(e.v as bigint) * e.n as s, if(z > b.best, z, b.best) as best, if(z > b.best, e.v, b.at) as at))[0]"
    return f"transform(array({whole}), t_ -> aggregate(h_, struct(0L as w, 0L as s, -1D as best, 0 as at), (b, e) -> {step}).at)[0]"


def notched(fy: int, fx: int) -> str:
    """Without one frequency and its mirror: its cosine and sine parts are subtracted."""
    angle = f"(2 * pi() * ({fy} * ({Y}) / h + {fx} * ({X}) / w))"
    part = lambda f: f"aggregate(zip_with(v, t_, (p, a) -> p * {f}(a)), 0D, (s, x) -> s + x)"
    own = f"if({2 * fy} % h = 0 and {2 * fx} % w = 0, 1D, 2D) / (h * w)"
    out = f"zip_with(v, t_, (p, a) -> cast(greatest(0D, least(255D, rint(p - {own} * (c_[0] * cos(a) + c_[1] * sin(a))))) as int))"
    return f"transform(array({every(angle)}), t_ -> transform(array(array({part('cos')}, {part('sin')})), c_ -> {out})[0])[0]"
