"""Feature columns. Chemistry needs rdkit, which is loaded only where it is installed; everything else is plain Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values for items without a conformer: success, elapsed, energy, deviation, missing flag.
MISSING = (0.0, None, None, None, 1.0)


def concatenated(*blocks: str) -> Column:
    """One array from blocks of features; a missing block makes the whole NULL."""
    return F.concat(*[F.col(b).cast("array<double>") for b in blocks])


def modality_dropout(df: DataFrame, block: str) -> DataFrame:
    """Every row twice: with the block and with zeros in its place (`dropped`)."""
    zeros = df.withColumn(block, F.transform(block, lambda x: x * 0)).withColumn("dropped", F.lit(True))
    return df.withColumn("dropped", F.lit(False)).unionByName(zeros)


def manifest_features(items: DataFrame, manifest: DataFrame, item: str = "mol_id") -> DataFrame:
    """success, elapsed_sec, energy_mean, rmsd_mean and missing; rows without an entry get the defaults."""
    known = manifest.select(item, F.col("success").cast("double").alias("success"), "elapsed_sec", "energy_mean", "rmsd_mean", F.lit(0.0).alias("missing"))
    out = items.join(known, item, "left")
    return out.withColumn("success", F.coalesce("success", F.lit(MISSING[0]))).withColumn("missing", F.coalesce("missing", F.lit(MISSING[-1])))


def corrupted(df: DataFrame, block: str, train: DataFrame, level: float, seed: int, item: str = "mol_id", least: float = 1e-6) -> DataFrame:
    """Adds normal noise of `level` training deviations to each feature; the same for an item wherever it is computed."""
    spread = train.select(F.posexplode(block).alias("at", "x")).groupBy("at").agg(F.greatest(F.stddev_pop("x"), F.lit(least)).alias("sd"))
    scale = np.array([r.sd for r in spread.orderBy("at").collect()])  # one number for each feature

    @F.pandas_udf("array<double>")
    def noisy(x: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, float) + level * scale * np.random.default_rng([seed, int(i) & 0xFFFFFFFF]).normal(size=len(v)) for v, i in zip(x, ids, strict=True)])

    return df.withColumn(block, noisy(block, item))


def canonical_smiles():
    """A column function from SMILES to canonical SMILES; invalid ones become NULL."""
    from rdkit import Chem

    @F.pandas_udf("string")
    def canonical(smiles: pd.Series) -> pd.Series:
        mols = smiles.map(lambda s: Chem.MolFromSmiles(s) if s else None)
        return mols.map(lambda m: Chem.MolToSmiles(m) if m is not None else None)

    return canonical


def morgan_bits(bits: int = 2048, radius: int = 2):
    """A column function from SMILES to a bit fingerprint as array<float>."""
    from rdkit import Chem
    from rdkit.Chem import rdFingerprintGenerator

    @F.pandas_udf("array<float>")
    def fingerprint(smiles: pd.Series) -> pd.Series:
        make = rdFingerprintGenerator.GetMorganGenerator(radius=radius, fpSize=bits)
        mols = smiles.map(lambda s: Chem.MolFromSmiles(s) if s else None)
        return mols.map(lambda m: make.GetFingerprintAsNumPy(m).astype("float32") if m is not None else None)

    return fingerprint


def scaffolds():
    """A column function from SMILES to its Bemis-Murcko scaffold, or the SMILES itself where it has none."""
    from rdkit.Chem.Scaffolds import MurckoScaffold

    @F.pandas_udf("string")
    def scaffold(smiles: pd.Series) -> pd.Series:
        return smiles.map(lambda s: (MurckoScaffold.MurckoScaffoldSmiles(smiles=s) or s) if s else None)

    return scaffold


def feature_groups(chemistry: Sequence[str], uncertainty: Sequence[str], geometry: Sequence[str], support: Sequence[str]) -> dict[str, list[str]]:
    """Nested sets of router features."""
    base = list(chemistry)
    return {
        "chemistry": base,
        "chemistry+uncertainty": [*base, *uncertainty],
        "chemistry+geometry": [*base, *geometry],
        "chemistry+support": [*base, *support],
        "full": [*base, *uncertainty, *geometry, *support],
    }
