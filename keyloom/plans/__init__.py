"""Plan shapes over a total order that stay parallel without a partition key."""
