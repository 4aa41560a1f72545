"""Event signatures: the first topic of each log that the decoders know."""

# Keccak-256 of the canonical event signatures.
PAIR_CREATED = "0x0d3648bd0f6ba80134a33ba9275ac585d9d315f0ad8355cddefde31afa28d0e9"
SWAP_V2 = "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822"
MINT_V2 = "0x4c209b5fc8ad50758f13e2e1088ba56a560dff690a1c6fef26394f4c03821c4f"
BURN_V2 = "0xdccd412f0b1252819cb1fd330b93224ca42612892bb3f4f789976e6d81936496"
SYNC = "0x1c411e9a96e071241c2f21f7726b17ae89e3cab4c78be50e062b03a9fffbbad1"
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
POOL_CREATED = "0x783cca1c0412dd0d695e784568c96da2e9c22ff989357a2e8b1d9b2b4e6b7118"
INITIALIZE = "0x98636036cb66a9c19a37435efc1e90142190214e8abeb821bdba3f2990dd4c95"
SWAP_V3 = "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
MINT_V3 = "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde"
BURN_V3 = "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c"
COLLECT = "0x70935338e69775456b0c0043e55b3188a159c4f5e6de2a46547cb5286cd0a097"
FLASH = "0xbdbdb71d7860376ba52b25a5028beea23581364a40522f6bcfb86bb1f2dca633"
ADDRESS_FROZEN = "0x7fa523c84ab8d7fc5b72f08b9e46dbbf10c39e119a075b3e317002d14bc9f436"
TOKENS_FROZEN = "0xa065e63c631c86f1b9f66a4a2f63f2093bf1c2168d23290259dbd969e0222a45"
TOKENS_UNFROZEN = "0x9bed35cb62ad0dba04f9d5bfee4b5bc91443e77da8a65c4c84834c51bb08b0d6"
PAUSED = "0x62e78cea01bee320cd4e420270b5ea74000d11b0c9f74754ebdbfc544b05a258"
UNPAUSED = "0x5db9ee0a495bf2e6ff9c91a7834c1ba4fdd244a5e8aa4e537bd38aeae4b073aa"
RECOVERY_SUCCESS = "0xf0c9129a94f30f1caaceb63e44b9811d0a3edf1d6c23757f346093af5553fed0"
UPDATED_TOKEN_INFORMATION = "0x6a1105ac8148a3c319adbc369f9072573e8a11d3a3d195e067e7c40767ec54d1"
IDENTITY_REGISTRY_ADDED = "0xd2be862d755bca7e0d39772b2cab3a5578da9c285f69199f4c063c2294a7f36c"
COMPLIANCE_ADDED = "0x7f3a888862559648ec01d97deb7b5012bff86dc91e654a1de397170db40e35b6"
IDENTITY_REGISTERED = "0x6ae73635c50d24a45af6fbd5e016ac4bed179addbc8bf24e04ff0fcc6d33af19"
IDENTITY_REMOVED = "0x59d6590e225b81befe259af056324092801080acbb7feab310eb34678871f327"
IDENTITY_UPDATED = "0xe98082932c8056a0f514da9104e4a66bc2cbaef102ad59d90c4b24220ebf6010"
COUNTRY_UPDATED = "0x04ed3b726495c2dca1ff1215d9ca54e1a4030abb5e82b0f6ce55702416cee853"
IDENTITY_STORED = "0x0030dea7e9c9afaa2e3c9810f2fc9b5181f1bad74ca5a8db85f746a33585e747"
CLAIM_ADDED = "0x46149b18aa084502c3f12bc75e19eda8bda8d102b82cce8474677a6d0d5f43c5"
CLAIM_REMOVED = "0x3cf57863a89432c61c4a27073c6ee39e8a764bff5a05aebfbcdcdc80b2e6130a"
CLAIM_CHANGED = "0x3bab293fc00db832d7619a9299914251b8747c036867ec056cbd506f60135b13"
KEY_ADDED = "0x480000bb1edad8ca1470381cc334b1917fbd51c6531f3a623ea8e0ec7e38a6e9"
KEY_REMOVED = "0x585a4aef50f8267a92b32412b331b20f7f8b96f2245b253b9cc50dcc621d3397"
ONCHAIN_ID_APPROVED = "0xb3932da477fe5d6c8ff2eafef050c0f3a1af18fc07121001482600f36f3715d8"
ONCHAIN_ID_EXECUTED = "0x1f920dbda597d7bf95035464170fa58d0a4b57f13a1c315ace6793b9f63688b8"
TRUSTED_ISSUER_ADDED = "0xfedc33fd34859594822c0ff6f3f4f9fc279cc6d5cae53068f706a088e4500872"
TRUSTED_ISSUER_REMOVED = "0x2214ded40113cc3fb63fc206cafee88270b0a903dac7245d54efdde30ebb0321"
CLAIM_TOPICS_UPDATED = "0xec753cfc52044f61676f18a11e500093a9f2b1cd5e4942bc476f2b0438159bcf"
CLAIM_TOPIC_ADDED = "0x01c928b7f7ade2949e92366aa9454dbef3a416b731cf6ec786ba9595bbd814d6"
CLAIM_TOPIC_REMOVED = "0x0b1381093c776453c1bbe54fd68be1b235c65db61d099cb50d194b2991e0eec5"
MODULE_ADDED = "0xead6a006345da1073a106d5f32372d2d2204f46cb0b4bca8f5ebafcbbed12b8a"
MODULE_REMOVED = "0x0a1ee69f55c33d8467c69ca59ce2007a737a88603d75392972520bf67cb513b8"
TOKEN_BOUND = "0x2de35142b19ed5a07796cf30791959c592018f70b1d2d7c460eef8ffe713692b"
TOKEN_UNBOUND = "0x28a4ca7134a3b3f9aff286e79ad3daadb4a06d1b43d037a3a98bdc074edd9b7a"
MODULE_INTERACTION = "0x20d79de70adcc6e9353d8a9a5646b46dc352710d0a310b1ad1f67faeca7ef891"
INITIALIZE_V4 = "0x344560c924012b32cbed54ad0e83e24c2cf3e723de46e06c72e6ab3463a7a8c0"
MODIFY_LIQUIDITY = "0xf208f4912782fd87d4a358e8291c46e9fefb649e838a67dcaa5db23503a4f53b"
SWAP_V4 = "0x40e9cecb9f5f1f1c5b9c97dec2917b7ee92e57ba5563708daca94dd84ad7112f"
SUBSCRIPTION = "0x572f161235911da04685a68c6b07422b4ba12dab20405b8b230c2420f49f1266"
UNSUBSCRIPTION = "0x6112cc683e05f5c607f9d5f0f57a0f0be2ca872a8f94ed4b6e2d09da2f1d1882"
PROPOSAL_CREATED = "0x95f03e437e6d5037418f12bef80fc7e0a5f27754c078a1d5d3f62d39bac44e50"
VOTE_CAST = "0xb8e138887d0aa13bab447e82de9d5c1777041ecd21ca36ba824ff1e6c07ddda4"
PROPOSAL_EXECUTED = "0x712ae1383f79ac853f8d882153778e0260ef8f03b504e2866e0593e04d2b291f"
PROPOSAL_CANCELED = "0x789cf55be980739dad1d0699b93b58e806b51c9d96619bfa8fe0a28abaa7b30c"
PROPOSAL_QUEUED = "0x9a2e42fd6722813d69113e7d0079d3d940171428df7373df9c7f7617cfda2892"
DELEGATE_CHANGED = "0x3134e8a2e6d97e929a7e54011ea5485d7d196dd5f0ba4d4ef95803e8e3fc257f"
DELEGATE_VOTES_CHANGED = "0xdec2bacdd2f05b59de34da9b523dff8be42e5e38e818c82fdb0bae774387a724"
GUARDIAN_UPDATED = "0x064d28d3d3071c5cbc271a261c10c2f0f0d9e319390397101aa0eb23c6bad909"
GAUGE_ADDED = "0x0690c0953072daf431d5cdec64e67412376badca0df468b950c61659830da131"
GAUGE_UPDATED = "0x1e2a3ff4241a28030cd83b954fb7bb7843a2555c29dc5b18f269308414d3bfb8"
GAUGE_VOTE_CAST = "0xb4cfecf70861b7b150d8337780d34fb4cbc2114b5fb1fe51a5c5fca1849f7274"
WEIGHTS_UPDATED = "0x90dd5985ed06249c1f4c7a5a37394070d774f2bc35c0bea714388d778c8f44c2"
LOCK_DEPOSIT = "0x7162984403f6c73c8639375d45a9187dfd04602231bd8e587c415718b5f7e5f9"
LOCK_WITHDRAW = "0xf279e6a1f5e320cca91135676d9cb6e44ca8a08c0b88342bcdb1144f6511b568"
LOCK_SUPPLY = "0x5e2aa66efd74cce82b21852e317e5490d9ecc9e6bb953ae24d90851258cc2f5c"
KARMA_MINTED = "0x75a0780e98a4894b81145ffa61783249374538e763a84a56f131f73828eef94c"
KARMA_SLASHED = "0x3578cfe093e136b6c466311ff49a5625dff510e16844bed0f2731bc79bd0776d"
KARMA_DECAYED = "0x5a32bf6cb8d08258f53813b731b066fd8804a627f0f0e0d32b898895841cbc6a"
DID_LINKED = "0xabdbb33c848055c04a7674a4d96d0173f89f9f7718cd5426e7bcd81b4596182e"
VERIFIED = "0x04881682880396c5d7f330e192fcd4f8b3d4645842908712b7a005170b3120cc"
STAKED = "0xbde7f0ba1630d25515c7ab99ba47d5640b7ffb4c673b2a5464ae679195589298"
UNSTAKED = "0x7fc4727e062e336010f2c282598ef5f14facb3de68cf8195c2f23e1454b2b74e"
REBASED = "0xd1a8a452d776b1b6802824ca2e8489c6448e2cb0963f552a9a19ab4ae064ca58"
DEMURRAGE_APPLIED = "0x92dbe9af03191016deca349de5f6439fc2d722818b96f7b02948d780a913e8e5"
TIER_UPGRADED = "0xcbbf00b5f55f1857f9362f521999f79036413e420d1b236d6bc143af30db731a"
STAKE_MINTED = "0xc263b302aec62d29105026245f19e16f8e0137066ccd4a8bd941f716bd4096bb"
VAULT_RECEIVE = "0x746cac8d52ab53d373654cb1bce8a77880a4fb35eba8502e644d45fb9a3544ad"
VAULT_FLUSH = "0xe033d0823ab017f8b7b1b1ef1d3581d03692445a7c735ce6a0ff5a08b4da24a1"
FEE_GOV_RATE = "0x3b973ff951e1f8921bccbc08ec81caee7ec5ce63a5dd396974dc6722bc3a7a2d"
FEE_GOV_CHAIN = "0x27f091fa3f90d453118174c469e669f3553b1d54c67aaf94ede31b8f0d04f48f"
FEE_GOV_BROADCAST = "0x4f63312ce57db5d707657e7ad8f4f74d1e3269b1ba60ee968c0c810713123928"
ROUTER_WEIGHT = "0xf74e8b7d737d24757358039f81965e4a5b41873d22817a0a93a098bc4bdbb02a"
ROUTER_DISTRIBUTE = "0x4def474aca53bf221d07d9ab0f675b3f6d8d2494b8427271bcf43c018ef1eead"
ROUTER_CLAIM = "0x47cee97cb7acd717b3c0aa1435d004cd5b3c8c57d70dbceb4e4458bbd60e39d4"
FEES_RECEIVED = "0xffe15e5c651accdc94c3387fa6d493291053ff174cd74f8c8b7f8a820e5dd909"
VALIDATOR_REWARDS_RECEIVED = "0x9d77a73cf83a1a8caf4495066223f6e1c6758b9b03f54ea006254cca0108e27c"
SLASHING_APPLIED = "0xe0ce9feb262640cffce27987d6007683502f8828357b680a1d2a0902ff5f4c1c"
EMERGENCY_WITHDRAWAL = "0x23d6711a1d031134a36921253c75aa59e967d38e369ac625992824315e204f20"

AMM = (PAIR_CREATED, SWAP_V2, MINT_V2, BURN_V2, SYNC, TRANSFER, POOL_CREATED, INITIALIZE, SWAP_V3, MINT_V3, BURN_V3, COLLECT, FLASH, INITIALIZE_V4, MODIFY_LIQUIDITY, SWAP_V4)
SECURITIES = (ADDRESS_FROZEN, TOKENS_FROZEN, TOKENS_UNFROZEN, PAUSED, UNPAUSED, RECOVERY_SUCCESS, UPDATED_TOKEN_INFORMATION, IDENTITY_REGISTRY_ADDED, COMPLIANCE_ADDED, IDENTITY_REGISTERED, IDENTITY_REMOVED, IDENTITY_UPDATED, COUNTRY_UPDATED, IDENTITY_STORED, CLAIM_ADDED, CLAIM_REMOVED, CLAIM_CHANGED, KEY_ADDED, KEY_REMOVED, ONCHAIN_ID_APPROVED, ONCHAIN_ID_EXECUTED, TRUSTED_ISSUER_ADDED, TRUSTED_ISSUER_REMOVED, CLAIM_TOPICS_UPDATED, CLAIM_TOPIC_ADDED, CLAIM_TOPIC_REMOVED, MODULE_ADDED, MODULE_REMOVED, TOKEN_BOUND, TOKEN_UNBOUND, MODULE_INTERACTION)
GOVERNANCE = (PROPOSAL_CREATED, VOTE_CAST, PROPOSAL_EXECUTED, PROPOSAL_CANCELED, PROPOSAL_QUEUED, DELEGATE_CHANGED, DELEGATE_VOTES_CHANGED, GUARDIAN_UPDATED)
DAO = (GAUGE_ADDED, GAUGE_UPDATED, GAUGE_VOTE_CAST, WEIGHTS_UPDATED, LOCK_DEPOSIT, LOCK_WITHDRAW, LOCK_SUPPLY, KARMA_MINTED, KARMA_SLASHED, KARMA_DECAYED, DID_LINKED, VERIFIED, STAKED, UNSTAKED, REBASED, DEMURRAGE_APPLIED, TIER_UPGRADED, STAKE_MINTED)
TREASURY = (VAULT_RECEIVE, VAULT_FLUSH, FEE_GOV_RATE, FEE_GOV_CHAIN, FEE_GOV_BROADCAST, ROUTER_WEIGHT, ROUTER_DISTRIBUTE, ROUTER_CLAIM)
LIQUID = (FEES_RECEIVED, VALIDATOR_REWARDS_RECEIVED, SLASHING_APPLIED, EMERGENCY_WITHDRAWAL)
#: What the indexer asks for; everything else is dropped.
KNOWN = AMM + SECURITIES
#: Every signature that some decoder reads.
ALL = AMM + (SUBSCRIPTION, UNSUBSCRIPTION) + SECURITIES + GOVERNANCE + DAO + TREASURY + LIQUID
