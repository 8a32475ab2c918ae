"""K4: object-store (S3A) settings.

Every tidemark operator takes a Hadoop path, so an ``s3a://bucket/path``
works once these settings are on the session and the hadoop-aws jar is on
the classpath. Credentials always come from the caller.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The connection behaviour of the system we reproduce (a local
# S3-compatible store: TLS on, path-style access, one attempt, 5 s to
# connect, 10 s per request, s3:// routed to S3A).
S3A_SSL = True
S3A_PATH_STYLE = True
S3A_ATTEMPTS = 1
S3A_ESTABLISH_TIMEOUT_MS = 5000
S3A_TIMEOUT_MS = 10000
S3A_IMPL = "org.apache.hadoop.fs.s3a.S3AFileSystem"
# ---------------------------------------------------------------------------


def s3a_conf(
    access_key: str,
    secret_key: str,
    endpoint: str,
    ssl: bool = S3A_SSL,
    path_style: bool = S3A_PATH_STYLE,
    attempts: int = S3A_ATTEMPTS,
    establish_timeout_ms: int = S3A_ESTABLISH_TIMEOUT_MS,
    timeout_ms: int = S3A_TIMEOUT_MS,
    prefix: str = "spark.hadoop.",
) -> dict[str, str]:
    """Hadoop S3A settings; with ``prefix`` they can go straight into a
    SparkSession builder or spark-submit ``--conf``."""
    conf = {
        "fs.s3a.access.key": access_key,
        "fs.s3a.secret.key": secret_key,
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.connection.ssl.enabled": str(bool(ssl)).lower(),
        "fs.s3a.path.style.access": str(bool(path_style)).lower(),
        "fs.s3a.attempts.maximum": str(int(attempts)),
        "fs.s3a.connection.establish.timeout": str(int(establish_timeout_ms)),
        "fs.s3a.connection.timeout": str(int(timeout_ms)),
        "fs.s3.impl": S3A_IMPL,
    }
    return {prefix + k: v for k, v in conf.items()}
