"""Software supply-chain risk analytics on Spark."""
