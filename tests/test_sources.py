"""Round trips of frames and sound, and features with known truth."""

import numpy as np
from pyspark.sql import functions as F

from mediaframe.functions import pixels as P
from mediaframe.operators import media as M
from mediaframe.sources import frames as R
from mediaframe.sources import sound as W
from mediaframe.sources.files import write_file


def clip(path, n=20, w=16, h=12):
    rng = np.random.default_rng(2)
    frames = rng.integers(0, 255, (n, h, w)).astype(np.uint8)
    frames[5:9] = frames[5]
    raw = b"YUV4MPEG2 W16 H12 F25:1 Cmono\n" + b"".join(b"FRAME\n" + f.tobytes() for f in frames)
    write_file(str(path), raw)
    return frames


def test_y4m_with_pushdown(spark, tmp_path):
    frames = clip(tmp_path / "a.y4m")
    R.register(spark)
    df = spark.read.format("rawframes").option("path", str(tmp_path / "a.y4m")).option("slice_frames", 6).load()
    got = df.orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == list(range(20)) and got[3].t_us == 120000
    assert all(bytes(r.pixels) == f.tobytes() for r, f in zip(got, frames))
    assert [r.frame_index for r in df.where("t_us >= 200000 and t_us < 320000").orderBy("t_us").collect()] == [5, 6, 7]


def test_features_across_chunks(spark, tmp_path):
    frames = clip(tmp_path / "b.y4m")
    R.register(spark)
    df = spark.read.format("rawframes").option("path", str(tmp_path / "b.y4m")).load()
    got = {r.frame_index: r for r in M.frame_features(df, chunk=4).collect()}
    assert len(got) == 20 and got[0].frac == 0 and got[6].frac == 0 and got[8].mad == 0 and got[4].frac > 0
    for i in (3, 4, 9, 12):
        a, b = P.blur(frames[i - 1]), P.blur(frames[i])
        assert abs(got[i].mad - np.abs(a - b).mean()) < 1e-9
    motion = {r.frame_index: r for r in M.motion_features(df, chunk=4).collect()}
    assert motion[7].changed == 0 and motion[4].changed == P.motion_row(frames[3], frames[4])["changed"]


def test_wav_round_trip_and_flux(spark, tmp_path):
    x = np.zeros(20000, np.float32)
    x[9000:9400] = np.sin(np.arange(400) * 0.4)
    write_file(str(tmp_path / "a.wav"), W.wav(x))
    pcm = W.pcm(spark, [str(tmp_path / "a.wav")], chunk=8000)
    rows = pcm.orderBy("chunk").collect()
    assert [len(r.samples) for r in rows] == [8000, 8000, 4000]
    assert np.abs(np.concatenate([r.samples for r in rows]) - x).max() < 1e-4
    whole = P.spectral_flux(np.concatenate([r.samples for r in rows]).astype(np.float64))
    got = {r.frame: r.flux for r in M.flux(pcm).collect()}
    assert sorted(got) == list(range(len(whole)))
    assert max(abs(got[k] - whole[k]) for k in got) < 1e-6
    energy = M.hop_energy(pcm).agg(F.sum("energy"), F.sum("n")).first()
    assert abs(energy[0] - float((x.astype(float) ** 2).sum())) < 0.1 and energy[1] == 20000
    W.write_wav(pcm, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.wav"))) == 3


def test_png_is_read_back(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 255, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "k1.png").write_bytes(R.png(image))
    r = R.images(spark, str(tmp_path / "p")).first()
    assert np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(5, 7, 3)[..., ::-1], image)


def test_regions_lists_and_the_frame_cache(spark, tmp_path):
    frames = clip(tmp_path / "c.y4m")
    R.register(spark)
    read = lambda: spark.read.format("rawframes").option("path", str(tmp_path / "c.y4m")).option("slice_frames", 4)
    got = read().option("region", "3,2,8,6").load().where(F.col("frame_index").isin(2, 7, 15)).orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == [2, 7, 15]
    assert all((r.w, r.h) == (8, 6) and bytes(r.pixels) == frames[r.frame_index][2:8, 3:11].tobytes() for r in got)
    asked = []

    def decode(missing):
        numbers = sorted(r.frame_index for r in missing.collect())
        asked.append(numbers)
        return read().load().where(F.col("frame_index").isin(numbers))

    name = str(tmp_path / "c.y4m")
    want = lambda *n: spark.createDataFrame([(name, i) for i in n], "video_id string, frame_index bigint")
    folder = str(tmp_path / "cache")
    assert sorted(r.frame_index for r in R.cached(spark, folder, want(1, 4), decode).collect()) == [1, 4]
    assert sorted(r.frame_index for r in R.cached(spark, folder, want(4, 6, 6), decode).collect()) == [4, 6]
    assert R.cached(spark, folder, want(1, 6), decode).count() == 2
    assert asked == [[1, 4], [6]]
