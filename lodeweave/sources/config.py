"""Settings from TOML files and the environment, and logging."""

from __future__ import annotations

import logging
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EtlConfig:
    data_dirs: list[str]
    num_threads: int | None = None
    minio_bucket: str | None = None


def load_config(path: str) -> EtlConfig:
    """data_dirs is required; the rest may be left out; other keys are an error of the file's author and are ignored."""
    found = tomllib.loads(Path(path).read_text())
    if not isinstance(found.get("data_dirs"), list):
        raise ValueError("data_dirs is required")
    return EtlConfig(found["data_dirs"], found.get("num_threads"), found.get("minio_bucket"))


@dataclass(frozen=True)
class ObjectStore:
    """Credentials of an S3-compatible store."""

    endpoint: str
    access_key: str = field(repr=False)
    secret_key: str = field(repr=False)
    region: str = "us-east-1"
    bucket: str | None = None
    ca_bundle: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> ObjectStore:
        need = ("AWS_ENDPOINT_URL", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY")
        missing = [k for k in need if not env.get(k)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        return cls(*(env[k] for k in need), env.get("AWS_REGION", "us-east-1"), env.get("MINIO_BUCKET"), env.get("AWS_CA_BUNDLE"))

    def hadoop(self) -> dict[str, str]:
        """Settings for s3a paths; plain http turns TLS off."""
        out = {
            "fs.s3a.endpoint": self.endpoint, "fs.s3a.access.key": self.access_key, "fs.s3a.secret.key": self.secret_key, "fs.s3a.endpoint.region": self.region,
            "fs.s3a.path.style.access": "true", "fs.s3a.connection.ssl.enabled": str(not self.endpoint.startswith("http://")).lower(),
        }
        return {f"spark.hadoop.{k}": v for k, v in out.items()}

    def tls(self) -> dict[str, str]:
        """Java options by which driver and executors trust the certificates of ca_bundle, a PEM file on each of them."""
        if not self.ca_bundle:
            return {}
        trust = f"-Djavax.net.ssl.trustStore={self.ca_bundle} -Djavax.net.ssl.trustStoreType=PEM"
        return {"spark.driver.extraJavaOptions": trust, "spark.executor.extraJavaOptions": trust}

    def write(self, df: DataFrame, path: str, mode: str = "overwrite") -> None:
        """Parquet to the bucket; executors upload their own parts."""
        for k, v in self.hadoop().items():
            df.sparkSession.conf.set(k.removeprefix("spark.hadoop."), v)
        df.write.mode(mode).parquet(f"s3a://{self.bucket}/{path}")


def session(config: EtlConfig, name: str = "lodeweave") -> SparkSession:
    """A session of num_threads local tasks, for runs outside a cluster."""
    threads = config.num_threads or "*"
    return SparkSession.builder.master(f"local[{threads}]").appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def logger(folder: str, name: str = "lodeweave", env: Mapping[str, str] = os.environ) -> logging.Logger:
    """A logger to the terminal and to a file that changes daily; its level is LOG_LEVEL, info if unset."""
    out = logging.getLogger(name)
    out.setLevel(env.get("LOG_LEVEL", "INFO").upper())
    if not out.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for h in (logging.StreamHandler(), TimedRotatingFileHandler(Path(folder) / f"{name}.log", when="midnight", utc=True)):
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            out.addHandler(h)
    return out
