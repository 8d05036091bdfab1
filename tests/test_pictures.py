"""Template and feature matching against slow versions, and image files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adweave.functions import matching
from adweave.functions.images import resized
from adweave.plans.pictures import texture
from adweave.sources import pictures


def slow_correlations(page, template):
    h, w = template.shape
    t = template - template.mean()
    out = np.zeros((page.shape[0] - h + 1, page.shape[1] - w + 1))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            win = page[y : y + h, x : x + w] - page[y : y + h, x : x + w].mean()
            if (win * win).sum() > 1e-6 * h * w and (t * t).sum() > 1e-6 * h * w:
                out[y, x] = (win * t).sum() / np.sqrt((win * win).sum() * (t * t).sum())
    return out


def test_correlations():
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (40, 53)).astype(float)
    page[5:30, 8:40] = 7  # flat windows
    page -= page.mean()
    for template in (rng.integers(0, 256, (9, 12)).astype(float), page[31:39, 2:20].copy(), np.full((5, 5), 3.0)):
        got = matching.correlations(page, template, np.fft.rfft2(page, (64, 64)), (64, 64))
        assert np.allclose(got, slow_correlations(page, template), atol=1e-6)


def test_template_match():
    page, asset = texture(1, 150, 200, 6), texture(2, 64, 80, 8)
    assert matching.template_match(page, asset) is None
    for w, h, x, y in ((40, 32, 13, 77), (81, 65, 5, 5)):
        p = page.copy()
        p[y : y + h, x : x + w] = resized(asset, h, w)
        assert matching.template_match(p, asset)[:4] == (x, y, w, h)
    assert matching.template_match(page, texture(3, 20, 20, 4), scales=(1.0,)) is None  # sides under 30 are passed over
    assert matching.template_match(page, texture(3, 300, 300, 4), scales=(1.0,)) is None
    assert len(matching.SCALES) == 50 and sum(s <= 0.5 for s in matching.SCALES) == 30


def test_no_scale_is_passed_over_that_reaches_the_correlation(monkeypatch):
    """The sieve in single precision gives what all scales in double precision give, also in dark windows of a bright page; a page's spectrum is made once for all its assets."""
    rng = np.random.default_rng(5)
    pages = []
    for k in range(6):
        page, asset = texture(k, 75, 100, 6), texture(20 + k, 40, 50, 8)
        h, w = 32 + k, 40 + k
        page[5 : 5 + h, 9 : 9 + w] = (resized(asset, h, w) * (0.02 if k % 2 else 1)).astype(np.uint8)
        pages.append((page, [asset, texture(40 + k, 40, 50, 8), rng.integers(0, 256, (40, 50)).astype(np.uint8)]))
    spectra, real = [], np.fft.rfft2
    monkeypatch.setattr(np.fft, "rfft2", lambda x, s: spectra.append(x.shape) or real(x, s))
    got = [matching.template_match(p, a) for p, assets in pages for a in assets]
    assert spectra.count((75, 100)) == len(pages)
    monkeypatch.setattr(matching._Page, "may_reach", lambda *a: True)
    assert got == [matching.template_match(p, a) for p, assets in pages for a in assets] and sum(x is not None for x in got) >= 3


def test_good_matches():
    rng = np.random.default_rng(6)
    b = rng.integers(0, 1 << 63, (700, 4)).astype(np.uint64)
    a = np.concatenate([b[:600] ^ (np.uint64(1) << rng.integers(0, 64, (600, 4)).astype(np.uint64)), rng.integers(0, 1 << 63, (60, 4)).astype(np.uint64)])
    d = np.array([[sum(int(x).bit_count() for x in r ^ q) for q in b[:80]] for r in a[:80]])
    two = np.sort(d, 1)
    want = [(r, int(d[r].argmin())) for r in range(80) if two[r, 0] < matching.RATIO * two[r, 1]]
    assert list(zip(*(x.tolist() for x in matching.good_matches(a[:80], b[:80])))) == want and len(want) > 40
    i, j = matching.good_matches(a, b)
    assert i[:600].tolist() == j[:600].tolist() == list(range(600))


def test_features_of_a_page_are_found_once(monkeypatch):
    calls, real = [], matching.features
    monkeypatch.setattr(matching, "features", lambda image, most=matching.FEATURES: calls.append(image.shape) or real(image, most))
    page, assets = texture(104, 240, 320, 7), [texture(105, 120, 160, 9), texture(106, 120, 160, 9)]
    other = texture(107, 240, 320, 7)
    for p in (page, other):
        for a in assets:
            matching.feature_match(p, a)
    assert sorted(calls) == [(120, 160)] * 2 + [(240, 320)] * 2


def slow_features(image):
    """Features of one level after the other, all points described, in double precision."""
    points, bits, strengths = [], [], []
    for level in range(8):
        f = 1.2**level
        h, w = int(image.shape[0] / f), int(image.shape[1] / f)
        if min(h, w) <= 42:
            break
        x = resized(image, h, w)
        mean = lambda v, n: sum(np.pad(v, n // 2, mode="edge")[i : i + h, j : j + w] for i in range(n) for j in range(n)) / n**2
        gy, gx = np.gradient(x)
        a, b, c = mean(gx * gx, 7), mean(gy * gy, 7), mean(gx * gy, 7)
        r = a * b - c * c - 0.04 * (a + b) ** 2
        soft = mean(x, 5)
        for i in range(20, h - 20):
            for j in range(20, w - 20):
                if r[i, j] == r[i - 1 : i + 2, j - 1 : j + 2].max() and r[i, j] > 1e-3 * r.max():
                    patch = x[i - 15 : i + 16, j - 15 : j + 16] * matching._DISC
                    t = np.arctan2((patch.sum(1) * np.arange(-15, 16)).sum(), (patch.sum(0) * np.arange(-15, 16)).sum())
                    at = lambda u, v: soft[i + np.rint(np.sin(t) * u + np.cos(t) * v).astype(int), j + np.rint(np.cos(t) * u - np.sin(t) * v).astype(int)]  # noqa: B023, E731
                    points.append((round((j + 0.5) * image.shape[1] / w - 0.5, 6), round((i + 0.5) * image.shape[0] / h - 0.5, 6)))
                    bits.append(at(*matching._PAIRS[:, :2].T) < at(*matching._PAIRS[:, 2:].T))
                    strengths.append(r[i, j])
    return points, np.array(bits), np.array(strengths)


def test_features_against_a_slow_version(monkeypatch):
    image = texture(108, 90, 110, 7)
    points, bits, strengths = slow_features(image)
    got, own = matching.features(image)
    mine = {tuple(p): np.unpackbits(d.view(np.uint8)) for p, d in zip(got.round(6).tolist(), own)}
    assert len(set(mine) ^ set(points)) <= 2 and len(points) > 60  # equal responses side by side may differ in their last digit
    assert np.mean([(mine[p] != d).mean() for p, d in zip(points, bits) if p in mine]) < 0.01
    described, real = [], matching._described
    monkeypatch.setattr(matching, "_described", lambda image, at: described.append(len(at)) or real(image, at))
    few, small = matching.features(image, 30)
    assert sum(described) == 30  # what isn't kept isn't described
    assert (few == got[:30]).all() and (small == own[:30]).all()


def test_matching_of_a_page_is_done_in_few_steps(monkeypatch):
    """Descriptors of a page are unpacked once for all its assets, and the tries of a consensus are solved together."""
    page, asset = texture(110, 240, 320, 7), texture(111, 120, 160, 9)
    page[40:160, 50:210] = asset
    signed, solved, signs, svd, qr = [], [], matching._signs, np.linalg.svd, np.linalg.qr
    monkeypatch.setattr(matching, "_signs", lambda bits: signed.append(1) or signs(bits))
    monkeypatch.setattr(np.linalg, "svd", lambda *a, **b: solved.append(1) or svd(*a, **b))
    monkeypatch.setattr(np.linalg, "qr", lambda *a, **b: solved.append(1) or qr(*a, **b))
    assert np.allclose(matching.feature_match(page, asset)[:4], (50, 40, 160, 120), atol=2) and matching.feature_match(page, texture(112, 120, 160, 9)) is None
    assert len(signed) == 3 and len(solved) == 2


def test_consensus_takes_the_tries_in_their_order():
    rng = np.random.default_rng(9)
    m = np.array([[1.1, 0.2, 30], [-0.1, 0.9, 5], [1e-4, -2e-4, 1]])
    for wrong in (5, 25, 45):
        src = rng.uniform(0, 200, (60, 2))
        dst = matching.projected(m, src)
        dst[60 - wrong :] = rng.uniform(0, 400, (wrong, 2))
        draw, best = np.random.Generator(np.random.PCG64(7)), np.zeros(60, bool)
        for k in range(1000):
            four = draw.choice(60, 4, replace=False)
            one = matching.homography(src[four], dst[four])
            if one is not None and (own := ((matching.projected(one, src) - dst) ** 2).sum(1) <= 25).sum() > best.sum():
                best = own
            if k >= 50 and best.mean() > 0.5:
                break
        one = matching.homography(src[best], dst[best])
        got, inside = matching.consensus(src, dst)
        assert np.allclose(got, one) and (inside == (((matching.projected(one, src) - dst) ** 2).sum(1) <= 25)).all()
    four = np.array([[0.0, 0], [10, 0], [0, 10], [10, 10]])
    assert np.allclose(matching.homography(four, four * 2 + 3), [[2, 0, 3], [0, 2, 3], [0, 0, 1]])


def test_pages_leave_a_task_a_few_at_a_time():
    import pyarrow as pa

    from adweave.plans import pictures as plans

    n = 150
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "asset": [k % 20 + 1 for k in range(n)], "x": [k % 30 for k in range(n)], "y": [k % 7 for k in range(n)], "width": [20 * (k % 2) for k in range(n)], "height": [10] * n})
    out = list(plans.page_batches(iter([rows]), 40, 60, 6, 16, 24, 8))
    assert [b.num_rows for b in out] == [64, 64, 22] and sum((b.column("page_id").to_pylist() for b in out), []) == list(range(n))
    for k in (0, 77, 149):
        page = texture(k * 1000 + 1, 40, 60, 6)
        if k % 2:
            page[k % 7 : k % 7 + 10, k % 30 : k % 30 + 20] = resized(texture((k % 20 + 1) * 1000 + 2, 16, 24, 8), 10, 20)
        assert out[k // 64].column("page_px")[k % 64].as_py() == page.tobytes()


@pytest.mark.parametrize("name", ["h21_image_hashes", "h25_template_match", "h26_feature_match"])
def test_images_are_made_by_many_tasks(spark, name):
    """Rows are dealt out before images are made of them, and no image is shuffled."""
    from adweave.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "_px" in x]
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM")


def moved(page, asset, scale, degrees, centre):
    """The page with the asset turned and scaled about its centre, bilinear."""
    out, (h, w), t = page.astype(float), asset.shape, np.deg2rad(degrees)
    yy, xx = np.mgrid[0 : page.shape[0], 0 : page.shape[1]]
    dx, dy = (xx - centre[0]) / scale, (yy - centre[1]) / scale
    u, v = np.cos(t) * dx + np.sin(t) * dy + w / 2, -np.sin(t) * dx + np.cos(t) * dy + h / 2
    ok = (u >= 0) & (u < w - 1) & (v >= 0) & (v < h - 1)
    i, j, a = v[ok].astype(int), u[ok].astype(int), asset.astype(float)
    fy, fx = v[ok] - i, u[ok] - j
    out[ok] = a[i, j] * (1 - fx) * (1 - fy) + a[i, j + 1] * fx * (1 - fy) + a[i + 1, j] * (1 - fx) * fy + a[i + 1, j + 1] * fx * fy
    return out.astype(np.uint8)


@pytest.mark.parametrize("scale,degrees", [(1.0, 0), (1.3, 0), (0.8, 0), (1.0, 20), (1.1, -35), (1.0, 90)])
def test_features_recover_the_outline(scale, degrees):
    page, asset, centre = texture(4, 320, 420, 7), texture(5, 120, 160, 9), (205, 155)
    got = matching.feature_match(moved(page, asset, scale, degrees, centre), asset)
    t = np.deg2rad(degrees)
    w, h = (scale * (abs(np.cos(t)) * a + abs(np.sin(t)) * b) for a, b in ((160, 120), (120, 160)))
    assert got is not None and np.allclose(got[:4], (centre[0] - w / 2, centre[1] - h / 2, w, h), atol=8)
    assert got[5] >= 18 and got[6] >= 13 and got[4] == round(min(1, got[6] / got[5]), 4)


def test_features_of_other_images():
    asset = texture(5, 120, 160, 9)
    assert matching.feature_match(texture(4, 320, 420, 7), asset) is None
    assert matching.feature_match(np.full((200, 200), 9, np.uint8), asset) is None
    assert matching.feature_match(asset, np.full((30, 30), 9, np.uint8)) is None


def test_homography():
    rng = np.random.default_rng(3)
    m = np.array([[1.1, 0.2, 30], [-0.1, 0.9, 5], [1e-4, -2e-4, 1]])
    src = rng.uniform(0, 200, (60, 2))
    dst = matching.projected(m, src)
    assert np.allclose(matching.homography(src, dst), m, atol=1e-6)
    dst[40:] = rng.uniform(0, 400, (20, 2))  # a third are wrong
    got, inside = matching.consensus(src, dst)
    assert inside[:40].all() and np.allclose(matching.projected(got, src[:40]), dst[:40], atol=1)


def test_places_of_odd_rows(spark):
    page, asset = texture(1, 150, 200, 6), texture(2, 64, 80, 8)
    page[20:84, 30:110] = asset
    rows = [(1, page.tobytes(), 200, asset.tobytes(), 80), (2, None, 200, asset.tobytes(), 80), (3, page.tobytes(), 0, asset.tobytes(), 80), (4, page.tobytes(), 200, b"", 80), (5, page.tobytes(), 199, asset.tobytes(), 80), (6, page.tobytes(), None, asset.tobytes(), None)]
    df = spark.createDataFrame(rows, "id int, p binary, pw int, a binary, aw int")
    got = {r.id: r.m for r in df.select("id", matching.template_place("p", "pw", "a", "aw").alias("m")).collect()}
    assert got[1][:5] == (30, 20, 80, 64, 1.0) or got[1].x == 30
    assert all(got[i].x is None for i in range(2, 7))


def test_png():
    rng = np.random.default_rng(6)
    rgb, grey = rng.integers(0, 256, (13, 17, 3)).astype(np.uint8), rng.integers(0, 256, (5, 9)).astype(np.uint8)
    assert (pictures.unpng(pictures.png(rgb)) == rgb).all()
    assert (pictures.unpng(pictures.png(grey)) == grey[..., None]).all()
    good = pictures.png(grey)
    for bad, what in ((b"", "not a PNG"), (good[:-6], "cut off|damaged"), (good[:40] + b"x" + good[41:], "damaged")):
        with pytest.raises(ValueError, match=what):
            pictures.unpng(bad)


def test_png_filters():
    """Rows of every filter type, as other encoders write them."""
    import struct
    import zlib

    rng = np.random.default_rng(7)
    x = rng.integers(0, 256, (10, 6, 3)).astype(np.int64)
    lines = x.reshape(10, 18)
    out = b""
    for y in range(10):
        f, cur = y % 5, lines[y]
        up = lines[y - 1] if y else np.zeros(18, int)
        left, corner = np.r_[0, 0, 0, cur[:-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        out += bytes([f]) + ((cur - [0 * cur, left, up, (left + up) // 2, paeth][f]) % 256).astype(np.uint8).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")
    assert (pictures.unpng(data) == x).all()


def test_optimised():
    x = np.zeros((2160, 1500, 3), np.uint8)
    x[:, 750:] = 200
    small = pictures.optimised(x, "screenshot")
    assert small.shape[:2] == (1080, 750) and pictures.optimised(x, "asset").shape[0] == 1024
    same = texture(8, 40, 40, 5)[..., None].repeat(3, 2)
    assert (pictures.optimised(same, "asset") == same).all()
    assert pictures.optimised(same, "default").astype(int).std() > same.astype(int).std()


def test_listing(spark, tmp_path):
    image = pictures.png(texture(1, 30, 40, 5))
    df = spark.createDataFrame([("a.png", image), ("b.PNG", image + bytes(9000)), ("c.txt", image), ("png", image), ("d.jpeg", b"no")], "name string, content binary")
    assert pictures.write_files(df, str(tmp_path / "in")) == 5
    kept, left = pictures.list_images(spark, str(tmp_path / "in"), 8000)
    assert "length" in kept._jdf.queryExecution().toString().split("PushedFilters")[1][:200]
    assert sorted(r.path[-6:].split("/")[-1] for r in kept.collect()) == ["a.png", "d.jpeg", "png"]
    assert {(r.path.split("/")[-1], r.reason) for r in left.collect()} == {("b.PNG", "size"), ("c.txt", "extension")}
    url = spark.createDataFrame([("data:image/png;base64,QUJD", None), ("http://x", b"xyz")], "u string, f binary")
    assert [bytes(r[0]) for r in url.select(pictures.image_bytes(F.col("u"), F.col("f"))).collect()] == [b"ABC", b"xyz"]
