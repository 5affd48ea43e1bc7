"""Gate, cuts and mixes against plain loops."""

import math
import random

import numpy as np
import pytest

from tessera.operators import frames, mixing, signal
from tessera.plans.source_queries import MadeTrack, made_project
from tessera.sources import audio


def plain_gains(rms, ratio, second):
    """One loop over frames with all of the gate's state."""
    floor_of = lambda a, b: max(sorted(rms[max(a, 0) : b])[len(rms[max(a, 0) : b]) // 10], 1e-6)
    floor = floor_of(0, 3000)
    limit, level, gain, open_for, hits, left, out = floor * ratio, 0.0, 0.0, 0, 0, 0, []
    for f, r in enumerate(rms):
        if f and f % second == 0:
            past = floor_of(f - second, f)
            if past > 3.16 * floor:
                hits += 1
                left = 3 * second if hits >= 2 and not left else left
            else:
                hits, floor = 0, 0.95 * floor + 0.05 * past
            limit = floor * ratio
        learning = left > 0
        if learning:
            left -= 1
            if not left:
                floor, hits, learning = floor_of(f - 3 * second, f + 1), 0, False
        level += (r - level) * (0.9 if r > level else 0.002)
        open_for = 3200 if level > (limit / 2 if learning else limit) else max(0, open_for - 320)
        goal = float(open_for > 0)
        gain += (goal - gain) * (0.05 if goal > gain else 0.0008)
        out.append(gain)
    return out


@pytest.mark.parametrize("second", [5, 50])
def test_gains_equal_the_loop(second):
    rng = np.random.default_rng(second)
    for n in (0, 1, 4, 49, 51, 700):
        rms = np.abs(rng.normal(0.001, 0.0003, n))
        rms[n // 3 :] *= 8  # the room gets louder and is learned anew
        rms[n // 2 : n // 2 + 20] += 0.2
        rms[2 * n // 3 :] /= 5
        assert np.allclose(signal.gate_gains(rms, 2.0, second), plain_gains(rms.tolist(), 2.0, second) if n else [], atol=1e-9)


def test_gate_of_frames_equals_that_of_the_take(spark):
    rng = np.random.default_rng(4)
    takes = {k: rng.normal(0, 0.01, (60, 32)) + (rng.random((60, 1)) > 0.7) * rng.normal(0, 0.5, (60, 32)) for k in range(3)}
    rows = [(k, f, [float(x) for x in v]) for k, t in takes.items() for f, v in enumerate(t)]
    got = signal.gate(spark.createDataFrame(rows, "take long, f long, samples array<double>"), second=5).orderBy("take", "f").collect()
    for k, take in takes.items():
        want = signal.denoise(take.ravel(), frame=32, second=5)
        assert np.allclose(np.concatenate([r.samples for r in got if r.take == k]), want, atol=1e-9)


def test_cuts_equal_the_loop(spark):
    rng = random.Random(7)
    rows, want = [], []
    for video in range(40):
        attention, duration = rng.choice([0, 33, 34, 66, 67, 100]), rng.choice([0, 5_000, 90_000, 3_000_000])
        times = [rng.randrange(max(1, duration * 2)) for _ in range(rng.choice([0, 1, 20, 300]))] + [0, 0, 500, 2_000, 5_000, 15_000]
        rows += [(video, attention, duration, t) for t in times]
        period, most = (1_000, 384) if attention >= 67 else (4_000, 192) if attention >= 34 else (10_000, 96)
        held = [k * period for k in range(min(most, duration // period + 1))]
        for t in sorted(times)[:128]:
            if len(held) < 512 and all(2 * abs(t - x) >= period for x in held):
                held.append(t)
                want.append((video, t))
    rows.append((1, 0, 5_000, None))
    got = frames.spaced_cuts(spark.createDataFrame(rows, "video long, attention long, duration long, t long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def plain_mix(tracks, rate):
    """Sample by sample, as the places of the mix ask for them."""
    solo = any(t.solo and not t.mute for t in tracks)
    mix = {}
    size = 0
    for t in tracks:
        if t.mute or (solo and not t.solo):
            continue
        skip = math.floor(t.trims[0] * t.rate + 0.5)
        kept = len(t.samples) - math.floor(t.trims[1] * t.rate + 0.5) - skip
        first, n = math.floor(t.offset * rate + 0.5), math.floor(kept / t.rate * rate + 0.5)
        if kept <= 0 or n <= 0:
            continue
        size = max(size, first + n)
        angle = (t.pan + 1) * math.pi / 4
        for s in range(n):
            at = skip + s * (t.rate / rate)
            i, part = math.floor(at), at - math.floor(at)
            if i >= len(t.samples):
                continue
            same = i + 1 < len(t.samples) and (i + 1) // t.block == i // t.block
            value = np.float32(t.samples[i]) * (1 - part) + (np.float32(t.samples[i + 1]) * part if same else 0)
            env = np.interp(s / rate, *zip(*t.points, strict=True)) if t.points else 1.0
            mix[first + s] = mix.get(first + s, 0.0) + value * env * t.gain * (math.cos(angle) + math.sin(angle)) / math.sqrt(2)
    out = np.array([mix.get(i, 0.0) for i in range(size)])
    peak = np.abs(out).max() if size else 0
    return out * 0.99 / peak if peak > 1 else out


def made(rng, rates):
    tracks = []
    for k in range(rng.randint(1, 4)):
        samples = [rng.uniform(-0.9, 0.9) for _ in range(rng.choice([1, 7, 100, 333]))]
        points = tuple(sorted((rng.uniform(0, 0.03), rng.uniform(0, 1.5)) for _ in range(rng.randint(0, 3))))
        tracks.append(MadeTrack(samples, k > 0 and rng.random() < 0.2, rng.random() < 0.2, rng.uniform(0.1, 1.5), rng.uniform(-1, 1), rng.choice(rates), rng.choice([0.0, 0.01, 0.25]), (rng.choice([0.0, 0.001]), rng.choice([0.0, 0.0005])), points, rng.choice([3, 50, 1 << 18])))
    return tracks


def test_mixes_of_tracks_at_other_rates(spark):
    rng = random.Random(11)
    projects = [made(rng, [8000.0, 4000.0, 11025.0, 44100.0, 8001.0]) for _ in range(40)]
    files = [(f"p{i}", made_project(t)) for i, t in enumerate(projects)] + [("bad", b"no project"), ("none", None), ("cut", made_project(projects[0])[:3000]), ("muted", made_project([MadeTrack([0.5], mute=True)]))]
    wants = {f"p{i}": plain_mix(t, 8000.0) for i, t in enumerate(projects)}
    for name, raw in files[:40]:
        if len(wants[name]):
            mix, rate = audio.render(raw)
            assert rate == 8000 and len(mix) == len(wants[name]) and np.allclose(mix, wants[name], atol=1e-6)
    rows = mixing.mixes(spark.createDataFrame(files, "path string, content binary"), piece=64).collect()
    assert {r.path for r in rows if r.error} == {"bad", "none", "cut", "muted"} | {k for k, v in wants.items() if not len(v)}
    for name, want in wants.items():
        got = np.zeros(len(want))
        for r in rows:
            if r.path == name and r.samples is not None:
                got[r.piece * 64 : r.piece * 64 + len(r.samples)] = r.samples
                assert r.places == len(want) and r.rate == 8000
        assert np.allclose(got, want, atol=1e-6)
