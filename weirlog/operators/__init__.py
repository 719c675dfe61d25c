"""DataFrame -> DataFrame operators over raw or clean request logs."""
