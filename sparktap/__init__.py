"""sparktap: analytics of captured API, TLS-plaintext and process activity on Spark."""
