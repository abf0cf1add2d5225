"""A movie with known regions."""


def planted(spark, frames=240, size=40, seed=7, planes=2):
    """plane, frame, arr: movies with six Gaussian regions that fire in bursts over noise, made on the executors from the frame number."""
    centres = [(7, 8), (9, 29), (20, 18), (30, 7), (31, 31), (19, 33)]

    def run(it):
        import numpy as np
        import pandas as pd

        y, x = np.mgrid[:size, :size]
        spots = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * 2.0**2)) for a, b in centres]
        for pdf in it:
            rows = []
            for k in pdf["id"]:
                plane, t = divmod(int(k), frames)
                image = np.random.default_rng([seed, int(k)]).normal(0, 0.3, (size, size))
                for n, s in enumerate(spots):
                    period = 37 + 11 * n + 5 * plane
                    image += 8 * np.exp(-((t + 13 * n) % period) / 5.0) * s
                rows.append((plane, t, image.ravel()))
            yield pd.DataFrame(rows, columns=["plane", "frame", "arr"])

    return spark.range(planes * frames).mapInPandas(run, "plane int, frame long, arr array<double>")
